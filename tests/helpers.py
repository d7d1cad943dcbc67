"""Plain Python counterparts of plan expressions."""

import math


def box_fit(x1, y1, x2, y2):
    """Path and level of a box, as the quadtree's ``fit`` computes them in a plan."""
    if x1 < -180 or y1 < -90 or x2 > 180 or y2 > 90:
        return 0, 0
    n = 1 << 22
    i, i_low = max(math.ceil((x2 + 180) * (n / 360.0)) - 1, 0), min(math.floor((x1 + 180) * (n / 360.0)), n - 1)
    j, j_high = min(math.floor((y1 + 90) * (n / 180.0)), n - 1), max(math.ceil((y2 + 90) * (n / 180.0)) - 1, 0)
    differ = lambda low, high: 0 if low >= high else (low ^ high).bit_length()
    path = sum(((~i >> k) & 1) << (2 * k) | ((~j >> k) & 1) << (2 * k + 1) for k in range(22))
    return path, 22 - max(differ(i_low, i), differ(j, j_high))

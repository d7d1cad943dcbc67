"""Bit interleaving as Column expressions.

Each expression names its argument a few times only: nested shift-and-mask steps would double it at each step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDTH = 8


def _spread(b: int) -> int:
    return sum((b >> k & 1) << 2 * k for k in range(_WIDTH))


def _table(values) -> Column:
    return F.lit(list(values)).cast("array<long>")


def spread_bits(v: Column, bits: int) -> Column:
    """The low ``bits`` bits of a number, bit k moved to bit 2k."""
    table = _table(_spread(b) for b in range(1 << _WIDTH))
    out = None
    for k in range(0, bits, _WIDTH):
        part = F.shiftleft(F.get(table, F.shiftright(v, k).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")), 2 * k)
        out = part if out is None else out.bitwiseOR(part)
    return out


def gather_bits(v: Column, bits: int) -> Column:
    """The inverse: bit 2k of a number moved to bit k; odd bits are left out."""
    table = _table(sum((b >> 2 * k & 1) << k for k in range(_WIDTH // 2)) for b in range(1 << _WIDTH))
    out = None
    for k in range(0, 2 * bits, _WIDTH):
        part = F.shiftleft(F.get(table, F.shiftright(v, k).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")), k // 2)
        out = part if out is None else out.bitwiseOR(part)
    return out

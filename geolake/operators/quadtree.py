"""The quadtree: cell codes by arithmetic, adaptive trees, assignment and pruning.

The root is the world, code 1. Children of c: top right 4c, top left 4c + 1, bottom right 4c + 2, bottom left 4c + 3. A box
belongs to the smallest cell that holds it, edges included; on a shared edge left wins over right and top over bottom.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolake.functions.bits import gather_bits, spread_bits
from geolake.functions.geometry import col

MAX_LEVEL, BASE_LEVEL = 22, 4
#: Rows for a tree that may be on the driver, and rows of a cell before it is split.
DRIVER_ROWS, MAX_ROWS = 150_000, 131_072
#: Distinct boxes that the driver takes as they are, however many rows it may hold.
GATHERED = 200_000


def fit(min_x, min_y, max_x, max_y) -> tuple[Column, Column]:
    """(path, level): the interleaved digits of the box's cell at level 22, and the deepest level whose cell holds the box.

    Level 0 with any path for boxes beyond the world, null for null bounds.
    """
    n = 1 << MAX_LEVEL
    u = lambda v, low, span: (col(v) - low) * (n / span)
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("long")
    left = lambda v, low, span: clamp(F.ceil(u(v, low, span)) - 1)
    right = lambda v, low, span: clamp(F.floor(u(v, low, span)))
    i, i_low = left(max_x, -180, 360.0), right(min_x, -180, 360.0)
    j, j_high = right(min_y, -90, 180.0), left(max_y, -90, 180.0)
    differ = lambda low, high: F.when(low >= high, 0).otherwise(F.length(F.bin(low.bitwiseXOR(high))))
    inside = (col(min_x) >= -180) & (col(max_x) <= 180) & (col(min_y) >= -90) & (col(max_y) <= 90)
    level = F.when(inside, MAX_LEVEL - F.greatest(differ(i_low, i), differ(j, j_high))).when(inside.isNotNull(), 0)
    flip = F.lit(n - 1)
    path = spread_bits(flip - i, MAX_LEVEL).bitwiseOR(F.shiftleft(spread_bits(flip - j, MAX_LEVEL), 1))
    return path, level.cast("int")


def _shift(v: Column, by: Column) -> Column:
    return F.call_function("shiftright", v, by.cast("int"))


def code_at(path: Column, level: Column) -> Column:
    """The code of a path's cell at a level."""
    top = F.lit(1 << (2 * MAX_LEVEL)).cast("long").bitwiseOR(path)
    return _shift(top, 2 * (MAX_LEVEL - level))


def quad_code(min_x, min_y, max_x, max_y, depth: int = BASE_LEVEL) -> Column:
    """Code of the smallest cell of at most ``depth`` levels that holds the box."""
    path, level = fit(min_x, min_y, max_x, max_y)
    return F.when(level.isNotNull(), code_at(path, F.least(level, F.lit(depth))))


def point_code(x, y, depth: int = BASE_LEVEL) -> Column:
    return quad_code(x, y, x, y, depth)


def parent(code) -> Column:
    return F.shiftright(col(code), 2)


def level_of(code) -> Column:
    return ((F.length(F.bin(col(code))) - 1) / 2).cast("int")


def cell_bounds(code: int) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax of a code; ValueError if it is none."""
    bits = bin(code)[2:] if code > 0 else ""
    if len(bits) % 2 != 1 or len(bits) > 2 * MAX_LEVEL + 1:
        raise ValueError(f"{code} is not a cell code")
    x1, y1, x2, y2 = -180.0, -90.0, 180.0, 90.0
    for k in range(1, len(bits), 2):
        xm, ym = x1 + (x2 - x1) / 2, y1 + (y2 - y1) / 2
        x1, x2 = (xm, x2) if bits[k + 1] == "0" else (x1, xm)
        y1, y2 = (ym, y2) if bits[k] == "0" else (y1, ym)
    return x1, y1, x2, y2


def cell_struct(code) -> Column:
    """The stored cell of a code: its bounds and the code."""
    code = col(code)
    level = level_of(code)
    digits = code.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level))

    n = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    i, j = n - 1 - gather_bits(digits, MAX_LEVEL), n - 1 - gather_bits(F.shiftright(digits, 1), MAX_LEVEL)
    w, h = 360.0 / n, 180.0 / n
    return F.when(code.isNotNull(), F.struct((i * w - 180).alias("min_x"), (j * h - 90).alias("min_y"), ((i + 1) * w - 180).alias("max_x"), ((j + 1) * h - 90).alias("max_y"), code.cast("long").alias("region_code")))


def _deepest(paths: np.ndarray) -> np.ndarray:
    return (np.int64(1) << np.int64(2 * MAX_LEVEL)) | paths.astype(np.int64)


@dataclass
class Boxes:
    """Boxes as paths and levels (:func:`fit`); each stands for ``weight`` rows, the same number or one for each."""

    paths: np.ndarray
    levels: np.ndarray
    weight: float | np.ndarray

    def weights(self) -> np.ndarray:
        return np.broadcast_to(np.asarray(self.weight, np.float64), self.paths.shape)

    def within(self, tree: Quadtree, leaves: set[int]) -> Boxes:
        """Those that would be counted at one of the leaves."""
        some = np.isin(tree.locate_all(self.paths, self.levels), sorted(leaves))
        return Boxes(self.paths[some], self.levels[some], self.weights()[some])


@dataclass
class Quadtree:
    """Nodes by code with the rows counted at them; a node with children has all four."""

    counts: dict[int, float] = field(default_factory=dict)
    split: set[int] = field(default_factory=set)

    @classmethod
    def initial(cls) -> Quadtree:
        tree = cls()
        tree.split = {c for level in range(BASE_LEVEL) for c in range(4**level, 2 * 4**level)}
        return tree

    def nodes(self) -> list[int]:
        return [1, *sorted(4 * c + d for c in self.split for d in range(4))]

    def locate(self, path: int, level: int) -> int:
        """The deepest node on a path that is not below ``level``."""
        top = 1 << (2 * MAX_LEVEL) | path
        at = 1
        for k in range(1, level + 1):
            if at not in self.split:
                break
            at = top >> 2 * (MAX_LEVEL - k)
        return at

    def insert_all(self, paths, levels, max_rows: int, fraction: float = 1.0) -> None:
        """Add sampled boxes one after another. Each counts 1 / fraction rows, whole ones with the rest carried on by node; a box that
        comes to a full leaf and fits a child splits it and is counted at that child. Earlier counts stay."""
        whole, rest = divmod(1 / fraction, 1)
        carried: dict[int, float] = {}
        limit = max(1, max_rows)
        for path, level in zip(paths, levels):
            at = self.locate(int(path), int(level))
            depth = (at.bit_length() - 1) // 2
            if at not in self.split and self.counts.get(at, 0) >= limit and depth < min(int(level), MAX_LEVEL):
                self.split.add(at)
                at = (1 << (2 * MAX_LEVEL) | int(path)) >> 2 * (MAX_LEVEL - depth - 1)
            more = carried.get(at, 0.0) + rest
            self.counts[at] = self.counts.get(at, 0) + whole + int(more)
            carried[at] = more - int(more)

    def grow(self, samples: list[Boxes], max_rows: int) -> None:
        """Split, level by level, each leaf that holds more than ``max_rows`` boxes which fit one of its children; no order matters."""
        paths, levels = (np.concatenate([getattr(s, k) for s in samples]) for k in ("paths", "levels"))
        weight = np.concatenate([s.weights() for s in samples])
        top = _deepest(paths)
        for depth in range(BASE_LEVEL, MAX_LEVEL):
            fits = levels > depth
            found, of = np.unique(top[fits] >> np.int64(2 * (MAX_LEVEL - depth)), return_inverse=True)
            full = set(found[np.bincount(of, weights=weight[fits], minlength=len(found)) > max_rows].tolist())
            if depth > BASE_LEVEL:
                full = {c for c in full if c >> 2 in self.split}
            self.split |= full
            if not full and not any((c.bit_length() - 1) // 2 == depth for c in self.split):
                break

    def locate_all(self, paths: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """:meth:`locate` of many boxes."""
        top, at, live = _deepest(paths), np.ones(len(paths), np.int64), np.arange(len(paths))
        depth_of: dict[int, list[int]] = {}
        for c in self.split:
            depth_of.setdefault((c.bit_length() - 1) // 2, []).append(c)
        for depth in sorted(depth_of):
            live = live[(levels[live] > depth) & np.isin(at[live], depth_of[depth])]
            at[live] = top[live] >> np.int64(2 * (MAX_LEVEL - depth - 1))
        return at

    def add(self, boxes: Boxes) -> None:
        """Count boxes at the nodes that hold them."""
        found, of = np.unique(self.locate_all(boxes.paths, boxes.levels), return_inverse=True)
        for c, k in zip(found.tolist(), np.bincount(of, weights=boxes.weights(), minlength=len(found)).tolist()):
            self.counts[c] = self.counts.get(c, 0) + k

    def crowded(self, boxes: Boxes, max_rows: int) -> set[int]:
        """Leaves that, with ``boxes``, may come to hold more than ``max_rows``, some of them stored there or in an outer cell before."""
        found, of = np.unique(self.locate_all(boxes.paths, boxes.levels), return_inverse=True)
        out = set()
        for c, k in zip(found.tolist(), np.bincount(of, weights=boxes.weights(), minlength=len(found)).tolist()):
            depth = (c.bit_length() - 1) // 2
            before = sum(self.counts.get(c >> 2 * up, 0) for up in range(depth - BASE_LEVEL + 1))
            if before and c not in self.split and before + k > max_rows:
                out.add(c)
        return out

    def merged(self, other: Quadtree) -> Quadtree:
        """The nodes of both trees."""
        return Quadtree({c: max(self.counts.get(c, 0), other.counts.get(c, 0)) for c in self.counts | other.counts}, self.split | other.split)

    def correct(self, stats: dict[int, int]) -> None:
        """Take true counts for the nodes in ``stats``; others keep their estimates."""
        known = set(self.nodes())
        self.counts |= {c: n for c, n in stats.items() if c in known}

    def to_json(self) -> str:
        return json.dumps({"split": sorted(self.split), "counts": sorted(self.counts.items())})

    @classmethod
    def from_json(cls, text: str) -> Quadtree:
        d = json.loads(text)
        return cls({int(c): n for c, n in d["counts"]}, set(d["split"]))

    def cells(self, spark) -> DataFrame:
        rows = [(c, (c.bit_length() - 1) // 2, *cell_bounds(c), float(self.counts.get(c, 0)), c in self.split) for c in self.nodes()]
        return spark.createDataFrame(rows, "code long, level int, xmin double, ymin double, xmax double, ymax double, count double, has_children boolean")

    def bounds(self, spark) -> DataFrame:
        """``__code, __cell``: the stored cell (:func:`cell_struct`) of each node but the root, computed once instead of by row."""
        codes = [c for c in self.nodes() if c > 1]
        names = ["min_x", "min_y", "max_x", "max_y"]
        nodes = spark.createDataFrame(pa.table([pa.array(codes, pa.int64()), *(pa.array(v, pa.float64()) for v in zip(*map(cell_bounds, codes)))], ["__code", *names]))
        return nodes.select("__code", F.struct(*names, F.col("__code").alias("region_code")).alias("__cell"))

    def parts(self, rows: int) -> list[tuple[int, int]]:
        """Each node's code and its part: the outermost node around it whose rows, all within it counted, are at most ``rows``; itself if none is."""
        total: dict[int, float] = {}
        for c, n in self.counts.items():
            while c:
                total[c] = total.get(c, 0) + n
                c >>= 2
        out = []
        for c in self.nodes():
            part = c
            while part > 1 and total.get(part >> 2, 0) <= rows:
                part >>= 2
            out.append((c, part))
        return out

    def cover(self, x1: float, y1: float, x2: float, y2: float) -> list[int]:
        """Codes of all nodes, inner ones included, that meet a box: rows written before a split keep the outer code."""
        out, stack = [], [1]
        while stack:
            c = stack.pop()
            a, b, d, e = cell_bounds(c)
            if c == 1 or (a <= x2 and d >= x1 and b <= y2 and e >= y1):
                out.append(c)
                if c in self.split:
                    stack += [4 * c + k for k in range(4)]
        return sorted(out)

    def cover_outside(self, x1: float, y1: float, x2: float, y2: float) -> list[int]:
        """Codes of all nodes that do not lie strictly inside a box."""
        inside = lambda c: (lambda b: b[0] > x1 and b[1] > y1 and b[2] < x2 and b[3] < y2)(cell_bounds(c))
        return [c for c in self.nodes() if not inside(c)]


def sample_boxes(df: DataFrame, bounds: Column, driver_rows: int = DRIVER_ROWS, order_by=None, seed: int = 42) -> Boxes:
    """At most about ``driver_rows`` boxes; only their paths and levels reach the driver. Boxes beyond the world and null boxes are left out."""
    total = df.count()
    fraction = min(1.0, driver_rows / total) if total else 1.0
    part = df if fraction >= 1 else df.sample(False, fraction, seed)
    path, level = fit(bounds["min_x"], bounds["min_y"], bounds["max_x"], bounds["max_y"])
    if order_by is not None:
        part = part.orderBy(*order_by)
    inside = (bounds["min_x"] >= -180) & (bounds["max_x"] <= 180) & (bounds["min_y"] >= -90) & (bounds["max_y"] <= 90)
    found = part.where(inside).select(path.alias("path"), level.alias("level")).toArrow()
    return Boxes(found.column("path").to_numpy(), found.column("level").to_numpy(), 1 / fraction)


class CountedBoxes:
    """All boxes of ``df`` that lie in the world, counted in the cluster by path and level; kept on the executors' disks until released."""

    def __init__(self, df: DataFrame, bounds: Column):
        path, level = fit(bounds["min_x"], bounds["min_y"], bounds["max_x"], bounds["max_y"])
        inside = (bounds["min_x"] >= -180) & (bounds["max_x"] <= 180) & (bounds["min_y"] >= -90) & (bounds["max_y"] <= 90)
        boxes = df.select(F.when(inside, path).alias("__path"), F.when(inside, level).alias("__level"))
        # others are left out when they are counted: a filter before would work out the bounds of each row again, and again by condition
        self.rows = boxes.groupBy("__path", "__level").agg(F.count("__path").alias("n")).where("n > 0").persist(StorageLevel.DISK_ONLY)

    def release(self) -> None:
        self.rows.unpersist()

    def few(self, driver_rows: int) -> bool:
        return self.rows.count() <= min(driver_rows, GATHERED)

    def boxes(self) -> Boxes:
        found = self.rows.toArrow()
        return Boxes(*(found.column(c).to_numpy() for c in ("__path", "__level", "n")))

    def condensed(self, split: set[int]) -> Boxes:
        """The boxes cut to the deepest node that holds them where ``split`` are split: to a tree with no other inner nodes they are the same."""
        found = located(self.rows, split, "code").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        codes = found.column("code").to_numpy()
        levels = np.array([(c.bit_length() - 1) // 2 for c in codes.tolist()], np.int64)
        shift = 2 * (MAX_LEVEL - levels)
        return Boxes((codes << shift) ^ (np.int64(1) << np.int64(2 * MAX_LEVEL)), levels, found.column("n").to_numpy())


def full_cells(rows: DataFrame, max_rows: int) -> set[int]:
    """Cells that hold more than ``max_rows`` counted boxes which fit one of their children: at most rows / ``max_rows`` of each level."""
    full: set[int] = set()
    for depth in range(BASE_LEVEL, MAX_LEVEL):
        cells = rows.where(F.col("__level") > depth).groupBy(code_at(F.col("__path"), F.lit(depth)).alias("code")).agg(F.sum("n").alias("n"))
        here = cells.where(F.col("n") > max_rows).select("code").toArrow().column("code").to_pylist()
        if not here:  # what a cell holds its parent holds, too
            break
        full.update(here)
    return full


def exact_boxes(parts: list[CountedBoxes], tree: Quadtree, driver_rows: int, max_rows: int) -> list[Boxes]:
    """Boxes from which ``tree`` grows as from all of ``parts``: the distinct ones, or, where those are many, cut to the cells that may be split."""
    if all([p.few(driver_rows // len(parts)) for p in parts]):
        return [p.boxes() for p in parts]
    rows = parts[0].rows
    for p in parts[1:]:
        rows = rows.unionByName(p.rows)
    split = tree.split | full_cells(rows, max_rows)
    return [p.condensed(split) for p in parts]


def build_tree(df: DataFrame, bounds: Column, tree: Quadtree | None = None, driver_rows: int = DRIVER_ROWS, max_rows: int = MAX_ROWS, mode: str = "balanced", order_by=None, seed: int = 42) -> Quadtree:
    """Grow a tree over boxes, counted at their nodes.

    ``sequential`` inserts at most about ``driver_rows`` sampled boxes in the order of ``order_by``, onto the counts of ``tree``; ``sampled``
    grows from such a sample, whatever its order; ``balanced`` grows from all boxes. Both know the boxes of ``df`` only
    (:meth:`geolake.plans.table.GeoTable.append_indexed` counts the rows of a table along).
    """
    tree = tree or Quadtree.initial()
    if mode == "balanced":
        counted = CountedBoxes(df, bounds)
        boxes = exact_boxes([counted], tree, driver_rows, max_rows)[0]
        counted.release()
    else:
        boxes = sample_boxes(df, bounds, driver_rows, order_by, seed)
    if mode == "sequential":
        tree.insert_all(boxes.paths, boxes.levels, max_rows, 1 / boxes.weight)
    else:
        tree.grow([boxes], max_rows)
        tree.add(boxes)
    return tree


def located(rows: DataFrame, split: set[int], code_col: str) -> DataFrame:
    """Add the code of the deepest node that holds each box (``__path``, ``__level``) where ``split`` are split."""
    deep = sorted(c for c in split if c >= 4**BASE_LEVEL)
    below = (deep[-1].bit_length() - 1) // 2 - BASE_LEVEL + 1 if deep else 0
    deepest, names = F.lit(BASE_LEVEL), []
    if deep:
        nodes = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"__c": pa.array(deep, pa.int64())})))
    for k in reversed(range(below.bit_length())):  # a node's outer cells are split, too: the depth is found bit by bit
        depth, name = deepest + ((1 << k) - 1), f"__n{k}"
        own = F.when(F.col("__level") > depth, code_at(F.col("__path"), depth))
        rows = rows.join(nodes.select(F.col("__c").alias(name)), own == F.col(name), "left")
        deepest = deepest + F.when(F.col(name).isNotNull(), 1 << k).otherwise(0)
        names.append(name)
    rows = rows.withColumn(code_col, F.when(F.col("__level").isNotNull(), code_at(F.col("__path"), F.least(F.col("__level"), deepest))))
    return rows.drop(*names)


def assign(df: DataFrame, bounds: Column, tree: Quadtree, code_col: str = "region_code") -> DataFrame:
    """Add the code of the deepest node of ``tree`` that holds each row's box; 1 beyond the world, null without bounds.

    The tree's inner nodes below the first four levels, at most rows / ``max_rows`` of each level, are broadcast once. Nodes are prefix-closed,
    so a binary search over the levels finds the depth: five hash joins at most.
    """
    path, level = fit(bounds["min_x"], bounds["min_y"], bounds["max_x"], bounds["max_y"])
    return located(df.withColumns({"__path": path, "__level": level}), tree.split, code_col).drop("__path", "__level")

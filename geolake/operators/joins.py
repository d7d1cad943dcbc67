"""Spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolake import schemas as S
from geolake.functions import geometry as G

#: A right side of at most so many bytes, once for each cell that it may go to, is broadcast whole.
SMALL = 8_000_000
#: Grids, each twice as coarse as the one before; the first one has cells of about the right side's mean extent.
GRIDS = 100
_ROW = 200
#: Bounds beyond this match nothing.
FAR = 1e15


def _level(bounds: Column, step: tuple[float, float]) -> Column:
    """The finest grid whose cells are as large as the box, so that it meets four of them at most."""
    wide = F.greatest((bounds["max_x"] - bounds["min_x"]) / step[0], (bounds["max_y"] - bounds["min_y"]) / step[1])
    return F.when(wide <= 1, 0).otherwise(F.least(F.ceil(F.log2(wide)), F.lit(GRIDS - 1))).cast("int")


def _cell(level: Column, i: Column, j: Column) -> Column:
    return F.struct(level.cast("int").alias("l"), i.cast("long").alias("i"), j.cast("long").alias("j"))


def _index(v: Column, low: float, step: float, level: Column) -> Column:
    return F.floor((v - low) / (F.lit(step) * F.pow(F.lit(2.0), level))).cast("long")


def grid_cover(bounds: Column, step: tuple[float, float], levels: list[int], own: Column) -> Column:
    """The cells that a box meets in its own grid and in each coarser one of ``levels``; closed on all sides."""

    def cells(k):
        xs = F.sequence(_index(bounds["min_x"], -180, step[0], k), _index(bounds["max_x"], -180, step[0], k))
        ys = F.sequence(_index(bounds["min_y"], -90, step[1], k), _index(bounds["max_y"], -90, step[1], k))
        return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: _cell(k, i, j))))

    used = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= own)
    return F.when(bounds["min_x"].isNotNull() & bounds["min_y"].isNotNull(), F.flatten(F.transform(used, cells)))


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str = "within", how: str = "inner", step: float | tuple[float, float] | None = None) -> DataFrame:
    """Join rows of which the left geometry lies within (or: contains) the right one.

    Cells of grids are the join keys. A box belongs to the grid whose cells are just as large (``step``, by default the mean extent
    of the right boxes, doubled as often as need be) and goes to the at most four cells it meets there, and to those in every coarser grid in
    use. A pair meets in the coarser of its two grids and is kept in the cell of the lower left corner of the common box, so nothing
    is found twice and neither a few huge boxes nor a dense region blow up the candidates. The right side is broadcast if its
    coordinates, for all cells, are ``SMALL``, else both are shuffled by cell, whatever Spark's threshold (AQE splits a crowded one). Candidates
    are filtered by bounds, then compared exactly, without Python where all inner geometries are points. ``how``: inner, left_semi or left_anti; for these two equal geometries
    of either side are compared once. Rows with null or empty geometries, or with infinite coordinates, match nothing.
    """
    if how != "inner":
        return _by_match(left, right, left_geom, right_geom, predicate, how, step)
    inner_first = predicate == "within"
    exact = {"within": G.st_within, "contains": G.st_contains}[predicate]
    names = left.columns
    clash = [c for c in right.columns if c in names]
    b = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c in clash else c) for c in right.columns])
    b_geom = f"__right_{right_geom}" if right_geom in clash else right_geom
    near = lambda c: (c["min_x"] >= -FAR) & (c["min_y"] >= -FAR) & (c["max_x"] <= FAR) & (c["max_y"] <= FAR)
    boxed = lambda df, g, name: df.withColumn(name, G.bbox(g)).where(near(F.col(name)))
    a, b = boxed(left, left_geom, "__a"), boxed(b, b_geom, "__b")
    x, y = F.col("__a"), F.col("__b")
    found = b.agg(F.avg(y["max_x"] - y["min_x"]).alias("w"), F.avg(y["max_y"] - y["min_y"]).alias("h"), F.max(y["max_x"]).alias("x2"), F.min(y["min_x"]).alias("x1"), F.max(y["max_y"]).alias("y2"), F.min(y["min_y"]).alias("y1"), F.count("*").alias("n"), F.sum(_ROW + 16 * F.size(F.col(b_geom)["x"])).alias("bytes")).first()
    if step is None:
        spread = max(1.0, float(found.n) ** 0.5)
        step = tuple(max(mean or 0.0, ((high or 0.0) - (low or 0.0)) / (4 * spread), 1e-9) for mean, high, low in ((found.w, found.x2, found.x1), (found.h, found.y2, found.y1)))
    elif not isinstance(step, tuple):
        step = (step, step)
    inner, inner_geom = (a, left_geom) if inner_first else (b, b_geom)
    points = inner.where(G.kind(inner_geom) != S.POINT).isEmpty()
    a, b = a.withColumn("__la", _level(x, step)), b.withColumn("__lb", _level(y, step))
    levels = sorted({r[0] for df, c in ((a, "__la"), (b, "__lb")) for r in df.select(c).distinct().collect()})  # GRIDS at most
    cells = lambda df, box, own, name: df.withColumn(name, F.explode(grid_cover(F.col(box), step, levels, F.col(own))))
    a, b = cells(a, "__a", "__la", "__ca"), cells(b, "__b", "__lb", "__cb")
    # left to the planner, a large side would be broadcast by an estimate that counts no cells
    b = F.broadcast(b) if 4 * len(levels) * (found.bytes or 0) <= SMALL else b.hint("merge")
    meet = (x["min_x"] <= y["max_x"]) & (x["max_x"] >= y["min_x"]) & (x["min_y"] <= y["max_y"]) & (x["max_y"] >= y["min_y"])
    pairs = a.join(b, F.col("__ca") == F.col("__cb")).where(meet)
    k = F.greatest("__la", "__lb")
    corner = _cell(k, _index(F.greatest(x["min_x"], y["min_x"]), -180, step[0], k), _index(F.greatest(x["min_y"], y["min_y"]), -90, step[1], k))
    pairs = pairs.where(F.col("__ca") == corner).where(exact(left_geom, b_geom, points)).drop("__a", "__b", "__la", "__lb", "__ca", "__cb")
    return pairs.select(*names, *[c if f"__right_{c}" not in pairs.columns else F.col(f"__right_{c}").alias(f"right_{c}") for c in right.columns])


def _by_match(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str, how: str, step) -> DataFrame:
    """The rows of ``left`` with a match, or without: that follows from a row's geometry, so the distinct ones are joined, then looked up."""
    fields = ("type", "x", "y", "parts")
    own = lambda df, g, name: df.select(F.struct(*[F.col(g)[f].alias(f) for f in fields]).alias(name)).distinct()
    pairs = spatial_join(own(left, left_geom, "__l"), own(right, right_geom, "__r"), "__l", "__r", predicate, "inner", step)
    hits = pairs.select(F.xxhash64("__l").alias("__hash"), *[F.col("__l")[f].alias(f"__{f}") for f in fields]).distinct()
    match = F.xxhash64(F.struct(*[F.col(left_geom)[f].alias(f) for f in fields])) == F.col("__hash")
    for f in fields:
        match = match & F.col(left_geom)[f].eqNullSafe(F.col(f"__{f}"))
    return left.join(hits, match, how)

"""Spatial functions as Column expressions over the flat layout (type, x, y, parts); no Python runs on the executors
but for parsing and writing WKB and the general ``st_contains``."""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from geolake import schemas as S
from geolake.functions import shapes, wkb

def no_cell() -> Column:
    return F.lit(None).cast(S.CELL)


def col(g) -> Column:
    return F.col(g) if isinstance(g, str) else g


def kind(g) -> Column:
    return col(g)["type"]


def flat_struct(type_, x, y, parts) -> Column:
    return F.struct(type_.cast("int").alias("type"), x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y"), parts.cast("array<int>").alias("parts"), no_cell().alias("bbox_partitioning"))


def _no_parts() -> Column:
    return F.array().cast("array<int>")


def st_point(x, y) -> Column:
    """A point, null if either coordinate is null."""
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), flat_struct(F.lit(S.POINT), F.array(x), F.array(y), _no_parts()))


def multipoint(xs, ys) -> Column:
    return flat_struct(F.lit(S.MULTIPOINT), col(xs), col(ys), _no_parts())


def st_polygon_from_envelope(x1, y1, x2, y2) -> Column:
    """The closed rectangle as a polygon: five points, counter-clockwise."""
    x1, y1, x2, y2 = (F.lit(v).cast("double") if not isinstance(v, Column | str) else col(v).cast("double") for v in (x1, y1, x2, y2))
    return flat_struct(F.lit(S.POLYGON), F.array(x1, x2, x2, x1, x1), F.array(y1, y1, y2, y2, y1), F.array(F.lit(0)))


def polygon_with_hole(x1, y1, x2, y2, hx1, hy1, hx2, hy2) -> Column:
    """A rectangle with a rectangular hole, which runs clockwise."""
    v = [col(c).cast("double") for c in (x1, y1, x2, y2, hx1, hy1, hx2, hy2)]
    a, b, c, d, e, f, g, h = v
    return flat_struct(F.lit(S.POLYGON), F.array(a, c, c, a, a, e, e, g, g, e), F.array(b, b, d, d, b, f, h, h, f, f), F.array(F.lit(0), F.lit(-5)))


def st_x(g) -> Column:
    return F.when(kind(g) == S.POINT, F.get(col(g)["x"], F.lit(0)))


def st_y(g) -> Column:
    return F.when(kind(g) == S.POINT, F.get(col(g)["y"], F.lit(0)))


def _at(g, index) -> Column:
    g = col(g)
    return F.when(F.get(g["x"], index).isNotNull(), flat_struct(F.lit(S.POINT), F.array(F.get(g["x"], index)), F.array(F.get(g["y"], index)), _no_parts()))


def st_point_n(g, n: int) -> Column:
    """The n-th point of a line, from 1, or from -1 backwards; null for other types."""
    return F.when(kind(g) == S.LINE, _at(g, F.lit(n - 1) if n > 0 else F.size(col(g)["x"]) + n))


def start_point(g) -> Column:
    return _at(g, F.lit(0))


def end_point(g) -> Column:
    return _at(g, F.size(col(g)["x"]) - 1)


def num_points(g) -> Column:
    return F.size(col(g)["x"])


def st_num_geometries(g) -> Column:
    """Members of a multi-geometry, 1 for others, 0 where there are no coordinates."""
    g, n = col(g), F.size(col(g)["x"])
    shells = F.size(F.filter(g["parts"], lambda p: p >= 0))
    return F.when(n == 0, 0).when(kind(g) == S.MULTIPOINT, n).when(kind(g).isin(S.MULTILINE, S.MULTIPOLYGON), shells).otherwise(1)


def line_from_multipoint(g) -> Column:
    """The line through a multipoint of two points or more; null for anything else."""
    g = col(g)
    return F.when((kind(g) == S.MULTIPOINT) & (F.size(g["x"]) >= 2), flat_struct(F.lit(S.LINE), g["x"], g["y"], _no_parts()))


def _least(v: Column) -> Column:
    """The least number; NaN counts as the greatest."""
    low = F.array_min(v)
    return F.when(~F.isnan(low), low)


def _greatest(v: Column) -> Column:
    """The greatest number, NaN left out. The lambda runs only where there is a NaN; as Spark compiles it apart, bounds and what is
    worked out from them do not grow into one method that the JVM would interpret (8,000 bytes)."""
    return F.array_max(F.when(F.isnan(F.array_max(v)), F.filter(v, lambda c: ~F.isnan(c))).otherwise(v))


def st_x_min(g) -> Column:
    return _least(col(g)["x"])


def st_x_max(g) -> Column:
    return _greatest(col(g)["x"])


def st_y_min(g) -> Column:
    return _least(col(g)["y"])


def st_y_max(g) -> Column:
    return _greatest(col(g)["y"])


def bbox(g) -> Column:
    """min_x, min_y, max_x, max_y; all null without coordinates; NaN is left out."""
    return F.struct(st_x_min(g).alias("min_x"), st_y_min(g).alias("min_y"), st_x_max(g).alias("max_x"), st_y_max(g).alias("max_y"))


def runs(g) -> Column:
    """Parts as (hole, first, end): rings, lines, or all points of a line or multipoint."""
    g = col(g)
    n = F.size(g["x"])
    starts = F.when(kind(g).isin(S.POLYGON, S.MULTILINE, S.MULTIPOLYGON), g["parts"]).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda p, i: F.struct((p < 0).alias("hole"), F.abs(p).alias("first"), F.coalesce(F.abs(F.get(starts, i + 1)), n).alias("end")))


def _steps(run: Column) -> Column:
    """Indexes of the points of a run that another follows; sequence() would count down for an empty run."""
    return F.when(run["end"] - run["first"] >= 2, F.sequence(run["first"], run["end"] - 2)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + f(v))


def signed_area(x: Column, y: Column, run: Column) -> Column:
    """Positive if the ring runs counter-clockwise."""
    x0 = F.get(x, run["first"])
    return _sum(_steps(run), lambda i: (F.get(x, i) - x0) * F.get(y, i + 1) - (F.get(x, i + 1) - x0) * F.get(y, i)) / 2


def _over_rings(g, value) -> Column:
    g = col(g)
    total = F.aggregate(runs(g), F.lit(0.0), lambda a, r: a + F.when(r["hole"], -F.abs(value(g, r))).otherwise(F.abs(value(g, r))))
    return F.when(g.isNull(), None).when(kind(g).isin(S.POLYGON, S.MULTIPOLYGON), total).otherwise(0.0)


def st_area(g) -> Column:
    """Planar area, holes taken off; 0 for points and lines."""
    return _over_rings(g, lambda g, r: signed_area(g["x"], g["y"], r))


def st_length(g) -> Column:
    """Planar length of lines, never across parts; 0 for other types."""
    g = col(g)
    step = lambda i: F.hypot(F.get(g["x"], i + 1) - F.get(g["x"], i), F.get(g["y"], i + 1) - F.get(g["y"], i))
    total = F.aggregate(runs(g), F.lit(0.0), lambda a, r: a + _sum(_steps(r), step))
    return F.when(g.isNull(), None).when(kind(g).isin(S.LINE, S.MULTILINE), total).otherwise(0.0)


def st_centroid(g) -> Column:
    """Centroid by the highest dimension present: mean of points, length-weighted segments, area-weighted rings."""
    g = col(g)
    x, y = g["x"], g["y"]

    def lines(pick):
        size = lambda i: F.hypot(F.get(x, i + 1) - F.get(x, i), F.get(y, i + 1) - F.get(y, i))
        mid = lambda i: (F.get(pick, i) + F.get(pick, i + 1)) / 2 * size(i)
        return F.aggregate(runs(g), F.lit(0.0), lambda a, r: a + _sum(_steps(r), mid)) / st_length(g)

    def rings(pick):
        def moment(r):
            x0, p0 = F.get(x, r["first"]), F.get(pick, r["first"])
            y0 = F.get(y, r["first"])
            cross = lambda i: (F.get(x, i) - x0) * (F.get(y, i + 1) - y0) - (F.get(x, i + 1) - x0) * (F.get(y, i) - y0)
            m = _sum(_steps(r), lambda i: (F.get(pick, i) + F.get(pick, i + 1) - 2 * p0) * cross(i)) / 6
            area = signed_area(x, y, r)
            return F.signum(area) * (m + p0 * area)

        return F.aggregate(runs(g), F.lit(0.0), lambda a, r: a + F.when(r["hole"], -moment(r)).otherwise(moment(r))) / st_area(g)

    def at(pick):
        mean = _sum(pick, lambda v: v) / F.size(pick)
        return F.when(st_area(g) > 0, rings(pick)).when(st_length(g) > 0, lines(pick)).otherwise(F.when(F.size(pick) > 0, mean))

    found = F.array(F.struct(at(x).alias("x"), at(y).alias("y")))  # bound once by transform
    return F.get(F.transform(found, lambda p: st_point(p["x"], p["y"])), F.lit(0))


#: WGS 84: equatorial radius, flattening.
EQUATOR, FLATTENING = 6378137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_Q_POLE = 1 - (1 - _E2) / (2 * _E) * math.log((1 - _E) / (1 + _E))
AUTHALIC_RADIUS = EQUATOR * math.sqrt(_Q_POLE / 2)


def authalic_sine(lat: Column) -> Column:
    """Sine of the authalic latitude of a geodetic latitude in degrees."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return F.least(F.greatest(q / _Q_POLE, F.lit(-1.0)), F.lit(1.0))


def _tan_half(s: Column) -> Column:
    """tan(b / 2) from sin(b) for b within a quarter turn."""
    return s / (1 + F.sqrt(1 - s * s))


def st_area_spheroid(g) -> Column:
    """Area on WGS 84 in square metres, holes taken off; x is longitude, y latitude in degrees.

    Spherical excess on the authalic sphere, to which the ellipsoid is mapped with equal areas: edges are arcs of that sphere's great
    circles, which for edges of a few kilometres differ from geodesics by less than double precision shows in the area.
    Rings around a pole are not supported.
    """

    def excess(g, r):
        x, y = g["x"], g["y"]

        def edge(i):
            turn = F.radians(F.get(x, i + 1) - F.get(x, i))
            turn = turn - 2 * math.pi * F.rint(turn / (2 * math.pi))
            a, b = _tan_half(authalic_sine(F.get(y, i))), _tan_half(authalic_sine(F.get(y, i + 1)))
            return 2 * F.atan2(F.tan(turn / 2) * (a + b), 1 + a * b)

        return _sum(_steps(r), edge) * AUTHALIC_RADIUS**2

    return _over_rings(g, excess)


class Envelope(NamedTuple):
    """An axis-aligned rectangle as four numbers or columns."""

    x1: object
    y1: object
    x2: object
    y2: object

    def polygon(self) -> Column:
        return st_polygon_from_envelope(*self)


def point_place(g, x: Column, y: Column) -> Column:
    """1 if a point lies inside polygon(s), 0 on an edge, -1 outside: the crossings of a ray to the right, ring by ring."""
    g = col(g)

    def crossed(side, i):
        x1, y1, x2, y2 = F.get(g["x"], i), F.get(g["y"], i), F.get(g["x"], i + 1), F.get(g["y"], i + 1)
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = (turn == 0) & (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2)) & (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))
        over = ((y1 > y) != (y2 > y)) & ((turn > 0) == (y2 > y1))
        return F.when(on, 0).when(over, -side).otherwise(side)

    def ring(state, r):
        side = F.aggregate(_steps(r), F.lit(-1), crossed)
        here = F.when(r["hole"] & (state["here"] >= 0), F.least(state["here"], -side)).when(r["hole"], state["here"]).otherwise(side)
        return F.struct(F.when(r["hole"], state["best"]).otherwise(F.greatest(state["best"], state["here"])).alias("best"), here.alias("here"))

    return F.aggregate(runs(g), F.struct(F.lit(-1).alias("best"), F.lit(-1).alias("here")), ring, lambda s: F.greatest(s["best"], s["here"]))


def _segments(g) -> Column:
    """All edges of lines and rings as (x1, y1, x2, y2); single points as edges of no length."""
    g = col(g)
    edge = lambda i, j: F.struct(F.get(g["x"], i).alias("x1"), F.get(g["y"], i).alias("y1"), F.get(g["x"], j).alias("x2"), F.get(g["y"], j).alias("y2"))
    several = F.filter(runs(g), lambda r: r["end"] > r["first"])
    edges = F.flatten(F.transform(several, lambda r: F.when(r["end"] - r["first"] == 1, F.array(edge(r["first"], r["first"]))).otherwise(F.transform(_steps(r), lambda i: edge(i, i + 1)))))
    dots = F.transform(g["x"], lambda x, i: edge(i, i))
    return F.when(kind(g).isin(S.POINT, S.MULTIPOINT), dots).otherwise(edges)


def _edge_distance(s: Column, t: Column) -> Column:
    """Distance of two edges: 0 where they cross, else the least of the four from an end to the other edge."""

    def to_edge(x, y, e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        size = dx * dx + dy * dy
        at = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / size))).otherwise(0.0)
        return F.hypot(x - e["x1"] - at * dx, y - e["y1"] - at * dy)

    def side(e, x, y):
        return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    crossed = (side(s, t["x1"], t["y1"]) * side(s, t["x2"], t["y2"]) < 0) & (side(t, s["x1"], s["y1"]) * side(t, s["x2"], s["y2"]) < 0)
    return F.when(crossed, 0.0).otherwise(F.least(to_edge(s["x1"], s["y1"], t), to_edge(s["x2"], s["y2"], t), to_edge(t["x1"], t["y1"], s), to_edge(t["x2"], t["y2"], s)))


def _starts_inside(a, b) -> Column:
    """Whether a part of ``b`` (each point, or the first point of each run) lies in the polygon(s) ``a`` or on their edge."""
    a, b = col(a), col(b)
    alone = kind(b).isin(S.POINT, S.MULTIPOINT)
    first = F.when(alone, F.when(F.size(b["x"]) > 0, F.sequence(F.lit(0), F.size(b["x"]) - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.transform(runs(b), lambda r: r["first"]))
    return F.when(kind(a).isin(S.POLYGON, S.MULTIPOLYGON), F.exists(first, lambda i: point_place(a, F.get(b["x"], i), F.get(b["y"], i)) >= 0)).otherwise(False)


def st_distance(a, b) -> Column:
    """Planar distance of two geometries: 0 where they touch or one lies in the other; null if either is null or empty."""
    a, b = col(a), col(b)
    points = F.hypot(st_x(a) - st_x(b), st_y(a) - st_y(b))
    none = F.lit(None).cast("double")
    apart = F.aggregate(_segments(a), none, lambda m, s: F.least(m, F.aggregate(_segments(b), none, lambda n, t: F.least(n, _edge_distance(s, t)))))
    within = _starts_inside(a, b) | _starts_inside(b, a)
    empty = (F.size(a["x"]) == 0) | (F.size(b["x"]) == 0)
    return F.when((kind(a) == S.POINT) & (kind(b) == S.POINT), points).when(a.isNull() | b.isNull() | empty, None).when(F.coalesce(within, F.lit(False)), 0.0).otherwise(apart)


def st_contains(a, b, points: bool = False) -> Column:
    """Whether polygon(s) ``a`` contain ``b``: nothing of b outside, some of it inside; null if ``a`` is of another type.

    An :class:`Envelope` needs comparisons only, a single point ray crossings; other geometries are compared in Python. Say
    ``points`` if there are points only: the plan then has no Python step (and other geometries give false).
    """
    if isinstance(a, Envelope):
        x1, y1, x2, y2 = (F.lit(v) if not isinstance(v, Column | str) else col(v) for v in a)
        inside = (st_x_min(b) >= x1) & (st_x_max(b) <= x2) & (st_y_min(b) >= y1) & (st_y_max(b) <= y2)
        edge = ((st_x_min(b) == st_x_max(b)) & ((st_x_min(b) == x1) | (st_x_min(b) == x2))) | ((st_y_min(b) == st_y_max(b)) & ((st_y_min(b) == y1) | (st_y_min(b) == y2)))
        return inside & ~edge

    def run(outer: pa.Array, inner: pa.Array) -> pa.Array:
        def one(o, i):
            if o is None or i is None:
                return None
            return shapes.contains(shapes.unflat(o["type"], o["x"], o["y"], o["parts"]), shapes.unflat(i["type"], i["x"], i["y"], i["parts"]))

        return pa.array([one(o, i) for o, i in zip(outer.to_pylist(), inner.to_pylist())], pa.bool_())

    run.__annotations__ = {"outer": pa.Array, "inner": pa.Array, "return": pa.Array}
    a, b = col(a), col(b)
    known = kind(a).isin(S.POLYGON, S.MULTIPOLYGON) & b.isNotNull()
    near = (st_x_min(b) >= st_x_min(a)) & (st_x_max(b) <= st_x_max(a)) & (st_y_min(b) >= st_y_min(a)) & (st_y_max(b) <= st_y_max(a))
    dot = (kind(b) == S.POINT) & (point_place(a, F.get(b["x"], F.lit(0)), F.get(b["y"], F.lit(0))) > 0)
    if points:
        return F.when(known, F.coalesce(near & dot, F.lit(False)))
    other = known & (kind(b) != S.POINT)
    slow = F.arrow_udf(run, "boolean")(F.when(other, a), F.when(other, b))
    return F.when(known, F.coalesce(near & F.when(kind(b) == S.POINT, dot).otherwise(slow), F.lit(False)))


def st_within(a, b, points: bool = False) -> Column:
    return st_contains(b, a, points)


def st_as_geojson(g) -> Column:
    """A GeoJSON geometry object."""
    g = col(g)
    pair = lambda i: F.array(F.get(g["x"], i), F.get(g["y"], i))
    line = lambda r: F.when(r["end"] > r["first"], F.transform(F.sequence(r["first"], r["end"] - 1), pair)).otherwise(F.array().cast("array<array<double>>"))
    rings = F.transform(runs(g), line)
    marked = F.transform(runs(g), lambda r: F.struct(r["hole"].alias("hole"), line(r).alias("ring")))
    empty = F.array().cast("array<array<array<array<double>>>>")
    polygons = F.aggregate(
        marked, empty,
        lambda a, m: F.when(m["hole"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.array(m["ring"]))))).otherwise(F.concat(a, F.array(F.array(m["ring"])))),
    )
    text = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    return (
        F.when(kind(g) == S.POINT, text("Point", pair(F.lit(0))))
        .when(kind(g) == S.LINE, text("LineString", F.get(rings, F.lit(0))))
        .when(kind(g) == S.MULTIPOINT, text("MultiPoint", F.get(rings, F.lit(0))))
        .when(kind(g) == S.MULTILINE, text("MultiLineString", rings))
        .when(kind(g) == S.POLYGON, text("Polygon", rings))
        .when(kind(g) == S.MULTIPOLYGON, text("MultiPolygon", polygons))
    )


def st_as_text(g) -> Column:
    """WKT; whole numbers without a fraction."""
    g = col(g)
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    pair = lambda i: F.concat(number(F.get(g["x"], i)), F.lit(" "), number(F.get(g["y"], i)))
    run = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.sequence(r["first"], r["end"] - 1), pair), ", "), F.lit(")"))
    rings = F.transform(runs(g), run)
    listed = F.concat(F.lit("("), F.array_join(rings, ", "), F.lit(")"))
    marked = F.transform(runs(g), lambda r: F.concat(F.when(r["hole"], ", ").otherwise("), ("), run(r)))
    polygons = F.concat(F.lit("("), F.substr(F.array_join(marked, ""), F.lit(4)), F.lit("))"))
    dots = F.concat(F.lit("("), F.array_join(F.transform(F.sequence(F.lit(0), F.size(g["x"]) - 1), lambda i: F.concat(F.lit("("), pair(i), F.lit(")"))), ", "), F.lit(")"))
    names = {S.POINT: "POINT", S.LINE: "LINESTRING", S.POLYGON: "POLYGON", S.MULTIPOINT: "MULTIPOINT", S.MULTILINE: "MULTILINESTRING", S.MULTIPOLYGON: "MULTIPOLYGON"}
    body = F.when(kind(g).isin(S.POINT, S.LINE), F.get(rings, F.lit(0))).when(kind(g) == S.MULTIPOINT, dots).when(kind(g) == S.MULTIPOLYGON, polygons).otherwise(listed)
    name = F.when(kind(g) == S.POINT, names[S.POINT])
    for k, n in names.items():
        name = name.when(kind(g) == k, n)
    return F.when(g.isNotNull(), F.concat(name, F.lit(" "), F.when(F.size(g["x"]) == 0, F.lit("EMPTY")).otherwise(body)))


def st_as_wkb(g) -> Column:
    """Little-endian WKB, by an Arrow UDF: SQL has no function that packs doubles. Spark plans no Python function over nested
    higher-order functions, so a computed geometry such as a centroid is to be stored in a table or cache first."""

    def run(g: pa.Array) -> pa.Array:
        return wkb.write(g)

    run.__annotations__ = {"g": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(col(g))

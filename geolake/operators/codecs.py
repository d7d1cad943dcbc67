"""Codecs between input geometries, the flat in-flight form and the four stored layouts.

In flight a geometry is the flat struct (type, x, y, parts); collections, which it cannot hold, are in flight as the nested
struct. Native expressions do all conversions between structs; Arrow UDFs parse and write WKB and WKT.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake import schemas as S
from geolake.functions import geometry as G
from geolake.functions import shapes, wkb

_PARTED = (S.POLYGON, S.MULTILINE, S.MULTIPOLYGON)


def _fields(layout: T.StructType) -> list[T.StructField]:
    return [f for f in layout.fields if f.name != "bbox_partitioning"]


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[kind.simpleString()]


def _single(shape):
    """Coordinates as 32-bit floats hold them."""
    near = lambda d: tuple(struct.unpack("<2f", struct.pack("<2f", *d))) if isinstance(d, tuple) and isinstance(d[0], float) else (d[0], near(d[1])) if isinstance(d, tuple) else [near(m) for m in d]
    return near(shape)


def parse(c, source: str, layout: str = "fsp", on_error: str = "null", precision: str = "double") -> Column:
    """WKB or WKT as a struct of a layout, without a cell; what cannot be read, or has no such form, is null or an error.

    ``precision='single'`` rounds WKT coordinates to 32-bit floats. Spark plans no higher-order function right over a Python function:
    put the result into a column (withColumn) before measuring it.
    """
    kind = S.LAYOUTS[layout]
    text = (lambda v: _single(shapes.from_wkt(v))) if precision == "single" else shapes.from_wkt

    def run(c: pa.Array) -> pa.Array:
        return to_layout_column(c, "wkb" if source == "wkb" else text, layout, on_error)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(G.col(c))


def to_layout_column(c: pa.Array, read, layout: str, on_error: str = "null") -> pa.Array:
    """A column of texts that ``read`` parses, or of WKB (``read="wkb"``), as structs of a layout."""
    arrow = _arrow(S.LAYOUTS[layout])
    parse_one = (lambda v: shapes.from_wkb(bytes(v))) if read == "wkb" else read

    def one(v):
        if v is None:
            return None
        try:
            return shapes.to_layout(parse_one(v), layout)
        except Exception:
            if on_error == "raise":
                raise
            return None

    if read != "wkb" or layout not in ("fsp", "nfsp"):
        return pa.array([one(v) for v in c.to_pylist()], arrow)
    found = wkb.read(c, on_error if layout == "fsp" else "null")
    out = found.to_arrow(arrow)
    if layout == "fsp" or not len(found.odd):
        return out
    return _patched(out, found.odd, pa.array([one(v) for v in c.take(pa.array(found.odd)).to_pylist()], arrow))


def _patched(column: pa.Array, rows, values: pa.Array) -> pa.Array:
    """``column`` with other values in some rows."""
    order = np.arange(len(column))
    order[rows] = len(column) + np.arange(len(values))
    return pa.concat_arrays([column, values]).take(pa.array(order))


def with_cell(g: Column, cell: Column | None = None) -> Column:
    return F.when(g.isNotNull(), g.withField("bbox_partitioning", G.no_cell() if cell is None else cell))


def _from_flat_sp(g: Column) -> Column:
    """Nested parts; shells run counter-clockwise, holes clockwise."""
    coordinates = lambda a, b: F.when(b > a, F.transform(F.sequence(a, b - 1), lambda i: F.struct(F.get(g["x"], i).alias("x"), F.get(g["y"], i).alias("y"))))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def part(r):
        points = F.coalesce(coordinates(r["first"], r["end"]), none)
        turn = (G.signed_area(g["x"], g["y"], r) > 0) == r["hole"]
        return F.struct(F.when(G.kind(g).isin(S.POLYGON, S.MULTIPOLYGON) & turn, F.reverse(points)).otherwise(points).alias("coordinates"))

    each = F.transform(F.arrays_zip(g["x"], g["y"]), lambda p: F.struct(F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coordinates")))
    parts = F.when(G.kind(g).isin(S.POINT, S.MULTIPOINT), each).otherwise(F.transform(G.runs(g), part))
    return F.struct(G.kind(g).alias("type"), parts.alias("parts"), g["bbox_partitioning"].alias("bbox_partitioning"))


def _to_flat_sp(g: Column) -> Column:
    axis = lambda name: F.flatten(F.transform(g["parts"], lambda p: F.transform(p["coordinates"], lambda c: c[name])))

    def clockwise(c):
        x0 = F.get(c, F.lit(0))["x"]
        steps = F.when(F.size(c) >= 2, F.sequence(F.lit(0), F.size(c) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(c, i)["x"] - x0) * F.get(c, i + 1)["y"] - (F.get(c, i + 1)["x"] - x0) * F.get(c, i)["y"]) <= 0

    def signed(acc, p):
        start = acc["n"]
        hole = F.when(g["type"] == S.POLYGON, start > 0).when(g["type"] == S.MULTIPOLYGON, clockwise(p["coordinates"]) & (start > 0)).otherwise(False)
        return F.struct((start + F.size(p["coordinates"])).alias("n"), F.concat(acc["parts"], F.array(F.when(hole, -start).otherwise(start))).alias("parts"))

    first = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("parts"))
    starts = F.aggregate(g["parts"], first, signed, lambda a: a["parts"])
    parts = F.when(g["type"].isin(*_PARTED), starts).otherwise(F.array().cast("array<int>"))
    return F.struct(g["type"].alias("type"), axis("x").alias("x"), axis("y").alias("y"), parts.alias("parts"), g["bbox_partitioning"].alias("bbox_partitioning"))


def _from_flat_nfsp(g: Column) -> Column:
    n = F.size(g["x"])
    starts = F.when(G.kind(g).isin(*_PARTED), g["parts"]).otherwise(F.array(F.lit(0)))
    parts = F.when(n == 0, F.array(F.lit(0), F.lit(-1))).otherwise(F.concat(starts, F.array(n - 1)))
    return F.struct(G.kind(g).alias("type"), g["x"].alias("x"), g["y"].alias("y"), parts.alias("parts"), F.array(G.kind(g)).alias("geometries"), g["bbox_partitioning"].alias("bbox_partitioning"))


def _to_flat_nfsp(g: Column) -> Column:
    """Simple geometries; a collection has no flat form and gives null (see :func:`collection_members`)."""
    starts = F.slice(g["parts"], 1, F.size(g["parts"]) - 1)
    parts = F.when(g["type"].isin(*_PARTED) & (F.size(g["x"]) > 0), starts).otherwise(F.array().cast("array<int>"))
    sound = (F.size(g["x"]) == F.size(g["y"])) & (F.element_at(g["parts"], -1) == F.size(g["x"]) - 1) & (F.get(g["parts"], F.lit(0)) == 0)
    flat = F.struct(g["type"].alias("type"), g["x"].alias("x"), g["y"].alias("y"), parts.alias("parts"), g["bbox_partitioning"].alias("bbox_partitioning"))
    return F.when(g["type"].between(1, 6), F.when(sound, flat).otherwise(F.raise_error(F.lit("not a nested geometry: parts do not match the coordinates")).cast(S.FSP)))


def nested_text(g) -> Column:
    """WKT of a nested struct, collections included; an error where it is malformed."""

    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if v is None else shapes.to_wkt(shapes.unnested(v["type"], v["x"], v["y"], v["parts"], v["geometries"])) for v in c.to_pylist()], pa.string())

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(G.col(g))


def nested_valid(g) -> Column:
    """Whether a nested struct decodes."""

    def one(v):
        try:
            shapes.unnested(v["type"], v["x"], v["y"], v["parts"], v["geometries"])
        except (ValueError, TypeError):
            return False
        return True

    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if v is None else one(v) for v in c.to_pylist()], pa.bool_())

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean")(G.col(g))


def collection_members(g) -> Column:
    """The simple geometries of a nested struct as an array of flat structs, in order, whatever the nesting."""
    fields = _fields(S.FSP)
    arrow = pa.list_(pa.struct([("type", pa.int32()), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.float64())), ("parts", pa.list_(pa.int32()))]))

    def leaves(shape):
        return [m for s in shape[1] for m in leaves(s)] if shape[0] == S.COLLECTION else [shape]

    def run(c: pa.Array) -> pa.Array:
        out = [None if v is None else [dict(zip(("type", "x", "y", "parts"), shapes.flat(m))) for m in leaves(shapes.unnested(v["type"], v["x"], v["y"], v["parts"], v["geometries"]))] for v in c.to_pylist()]
        return pa.array(out, arrow)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    members = F.arrow_udf(run, T.ArrayType(T.StructType(fields)))(G.col(g))
    return F.transform(members, lambda m: m.withField("bbox_partitioning", G.no_cell()))


@dataclass(frozen=True)
class Codec:
    """One stored layout: its schema, and expressions to and from the flat form."""

    name: str
    schema: T.StructType
    from_flat: Callable[[Column], Column]
    to_flat: Callable[[Column], Column]

    def encode(self, c, source: str = "flat", on_error: str = "null", precision: str = "double") -> Column:
        """A flat struct, or WKB or WKT, as this layout; null where it cannot be encoded.

        WKB input of the WKB layout is passed on unparsed.
        """
        c = G.col(c)
        if source == "wkb" and self.name == "wkb":
            return F.when(c.isNotNull(), F.struct(c.alias("geom"), G.no_cell().alias("bbox_partitioning")))
        if source != "flat":
            return parse(c, source, self.name, on_error, precision)
        return F.when(c.isNotNull(), self.from_flat(c))

    def decode(self, g) -> Column:
        g = G.col(g)
        return F.when(g.isNotNull(), self.to_flat(g))

    def bbox(self, g) -> Column:
        """Bounds straight from the stored columns where the layout has coordinates."""
        g = G.col(g)
        if self.name in ("fsp", "nfsp"):
            return G.bbox(g)
        if self.name == "sp":
            axis = lambda name: F.filter(F.flatten(F.transform(g["parts"], lambda p: F.transform(p["coordinates"], lambda c: c[name]))), lambda v: ~F.isnan(v))
            return F.struct(F.array_min(axis("x")).alias("min_x"), F.array_min(axis("y")).alias("min_y"), F.array_max(axis("x")).alias("max_x"), F.array_max(axis("y")).alias("max_y"))
        return wkb_bbox(g["geom"])

    def from_xy(self, x, y) -> Column:
        """A point, null if either coordinate is null."""
        return self.encode(G.st_point(x, y))


_BOUNDS = pa.struct([(n, pa.float64()) for n in ("min_x", "min_y", "max_x", "max_y")])


def wkb_bounds(c: pa.Array) -> pa.Array:
    """Bounds of a WKB column; of collections row by row."""

    def one(v):
        try:
            _, x, y, _, _ = shapes.nested(shapes.from_wkb(bytes(v)))
        except Exception:
            x = y = []
        x, y = [a for a in x if a == a], [a for a in y if a == a]
        return dict(zip(_BOUNDS.names, (min(x), min(y), max(x), max(y)) if x and y else (None,) * 4))

    found = wkb.read(c)
    out = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in found.bounds()], fields=list(_BOUNDS), mask=c.is_null())
    if not len(found.odd):
        return out
    return _patched(out, found.odd, pa.array([one(v) for v in c.take(pa.array(found.odd)).to_pylist()], _BOUNDS))


def wkb_bbox(c: Column) -> Column:
    """Bounds of WKB of any type, collections included; what cannot be read has none."""

    def run(c: pa.Array) -> pa.Array:
        return wkb_bounds(c)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in _BOUNDS.names]))(c)


CODECS = {
    "wkb": Codec("wkb", S.WKB, lambda g: F.struct(G.st_as_wkb(g).alias("geom"), g["bbox_partitioning"].alias("bbox_partitioning")), lambda g: with_cell(parse(g["geom"], "wkb"), g["bbox_partitioning"])),
    "sp": Codec("sp", S.SP, _from_flat_sp, _to_flat_sp),
    "fsp": Codec("fsp", S.FSP, lambda g: g, lambda g: g),
    "nfsp": Codec("nfsp", S.NFSP, _from_flat_nfsp, _to_flat_nfsp),
}


def encode_rows(df: DataFrame, codec: Codec, column: str = "geometry", source: str = "flat", on_error: str = "null", precision: str = "double") -> DataFrame:
    """Encode a column in place and leave out rows whose geometry is null or unreadable."""
    return df.withColumn(column, codec.encode(column, source, on_error, precision)).where(F.col(column).isNotNull())

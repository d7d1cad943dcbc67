"""SQL functions over spatial tables.

Their bodies are the Column expressions of this package, written out as SQL: temporary SQL functions, which the optimizer inlines, so that
nested columns are pruned and filters pushed down as if they had been written out, and which cannot drift from the Column API. Python
functions over whole Arrow columns only parse and write WKB and WKT, compare geometries other than points, and look cells up in a grown tree.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake import schemas as S
from geolake.functions import geohash as H
from geolake.functions import geometry as G
from geolake.functions import shapes, wkb
from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS, _arrow, to_layout_column, wkb_bounds
from geolake.shipping import ship_package

_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*')")
_FRACTION = re.compile(r"(?<![\w.`])(\d+\.\d+(?:E-?\d+)?|\d+E-?\d+)(?![\w.])")
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|<|>|=|\+|-|\*|/|%|\||&|\^|!|and|or|in|not|exists)\(")
_ALIAS = re.compile(r" AS ([a-z_]\w*)(?=[,)])")


def sql_text(c: Column) -> str:
    """A Column as SQL. Operators and keywords become calls by their quoted names, fractions doubles, aliases quoted."""
    parts = _QUOTED.split(c._jc.node().sql())
    for i in range(0, len(parts), 2):
        parts[i] = _ALIAS.sub(r" AS `\1`", _OPERATOR.sub(r"`\1`(", _FRACTION.sub(r"\1D", parts[i])))
    return "".join(parts)


_FLAT, _CELL, _D = S.FSP.simpleString(), S.CELL.simpleString(), "DOUBLE"
_BOX = T.StructType(S.CELL.fields[:4])
_G, _TWO = f"g {_FLAT}", f"a {_FLAT}, b {_FLAT}"


def _point_n() -> Column:
    n = F.col("n")
    size = F.size("g.x")
    return F.when((F.col("g.type") == S.LINE) & F.abs(n).between(1, size), G.st_point(F.get("g.x", F.when(n > 0, n - 1).otherwise(size + n)), F.get("g.y", F.when(n > 0, n - 1).otherwise(size + n))))


def _inlined() -> dict[str, tuple[str, str, Column]]:
    """name: (arguments, result, body), for flat structs."""
    return {
        "ST_X": (_G, _D, G.st_x("g")),
        "ST_Y": (_G, _D, G.st_y("g")),
        "ST_XMin": (_G, _D, G.st_x_min("g")),
        "ST_XMax": (_G, _D, G.st_x_max("g")),
        "ST_YMin": (_G, _D, G.st_y_min("g")),
        "ST_YMax": (_G, _D, G.st_y_max("g")),
        "ST_NumPoints": (_G, "INT", G.num_points("g")),
        "countCoordinates": (_G, "INT", G.num_points("g")),
        "ST_NumGeometries": (_G, "INT", G.st_num_geometries("g")),
        "ST_Point": ("x DOUBLE, y DOUBLE", _FLAT, G.st_point("x", "y")),
        "ST_PointN": (f"{_G}, n INT", _FLAT, _point_n()),
        "ST_StartPoint": (_G, _FLAT, G.start_point("g")),
        "ST_EndPoint": (_G, _FLAT, G.end_point("g")),
        "ST_Distance": (_TWO, _D, G.st_distance("a", "b")),
        "ST_Area": (_G, _D, G.st_area("g")),
        "ST_AreaSpheroid": (_G, _D, G.st_area_spheroid("g")),
        "ST_Length": (_G, _D, G.st_length("g")),
        "ST_Centroid": (_G, _FLAT, G.st_centroid("g")),
        "ST_AsText": (_G, "STRING", G.st_as_text("g")),
        "ST_AsGeoJSON": (_G, "STRING", G.st_as_geojson("g")),
        "ST_PolygonFromEnvelope": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", _FLAT, G.st_polygon_from_envelope("x1", "y1", "x2", "y2")),
        "ST_InBox": (f"{_G}, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "BOOLEAN", (F.col("x1") <= G.st_x_min("g")) & (F.col("x2") >= G.st_x_max("g")) & (F.col("y1") <= G.st_y_min("g")) & (F.col("y2") >= G.st_y_max("g"))),
        "multiPointToLine": (_G, _FLAT, G.line_from_multipoint("g")),
        "geoNum": ("x DOUBLE, y DOUBLE", "INT", H.geohash_numeric("x", "y")),
        "ST_GeoHash": ("x DOUBLE, y DOUBLE", "STRING", H.geohash("x", "y")),
    }


#: By session: the layout its functions are registered for (None: with a tree of their own), all names, and those of any layout.
_done: dict[str, tuple[str | None, list[str], list[str]]] = {}


def register_functions(spark: SparkSession, layout: str = "fsp", tree: Q.Quadtree | None = None) -> list[str]:
    """Register the functions for tables of a layout in this session; returns their names.

    ST_ functions and multiPointToLine take flat structs, as ``decodeGeometry`` and ``ST_GeomFromWKB`` return them (the flat layout is one
    itself). encodeGeometry takes WKB, or WKT through encodeGeometryText; calculateBbox, findBucket and addgeohash take the
    stored struct. findBucket uses ``tree``, by default the initial one of four levels; its result has nulls where there are no bounds. What
    cannot be read gives null. Spark plans no Python function over nested lambda functions: store a computed geometry before ST_AsWKB.
    """
    ship_package(spark)
    session, codec, own = spark._jsparkSession.sessionUUID(), CODECS[layout], S.LAYOUTS[layout].simpleString()
    done = _done.get(session)
    if done and tree is None and done[0] == layout:
        return list(done[1])
    names: list[str] = []

    def define(name: str, args: str, result: str, body: Column) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {sql_text(body)}")
        names.append(name)

    def python(name: str, f, result) -> None:
        spark.udf.register(name, F.arrow_udf(f, result))
        names.append(name)

    if done:
        names += done[2]
    else:
        for name, (args, result, body) in _inlined().items():
            define(name, args, result, body)
    shared = list(names)
    _python_functions(python, layout)
    _tree_function(python, tree)

    point = F.col("b.type") == S.POINT
    define("ST_Contains", _TWO, "BOOLEAN", F.when(point, G.st_contains("a", "b", points=True)).otherwise(F.call_function("geolake_contains", F.when(~point, F.col("a")), F.when(~point, F.col("b")))))
    define("ST_Within", _TWO, "BOOLEAN", F.call_function("ST_Contains", F.col("b"), F.col("a")))
    stored = f"g {own}"
    if layout == "wkb":
        flat, bounds = F.call_function("ST_GeomFromWKB", F.col("g.geom")), F.call_function("geolake_wkb_bounds", F.col("g.geom"))
        encoded = F.when(F.col("g").isNotNull(), F.struct(F.col("g").alias("geom"), G.no_cell().alias("bbox_partitioning")))
        made = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.call_function("ST_AsWKB", G.st_point("x", "y")).alias("geom"), G.no_cell().alias("bbox_partitioning")))
        at = G.st_centroid("g")
    else:
        flat, bounds, made = codec.decode("g"), codec.bbox("g"), codec.from_xy("x", "y")
        encoded = F.call_function("geolake_encode", F.col("g"))
        at = F.get("g.parts", F.lit(0))["coordinates"] if layout == "sp" else F.col("g")
    define("decodeGeometry", stored, _FLAT, flat)
    define("encodeGeometry", "g BINARY", own, encoded)
    define("createPointGeometry", "x DOUBLE, y DOUBLE", own, made)
    define("calculateBbox", stored, _BOX.simpleString(), bounds)
    first = lambda c: F.get(at, F.lit(0))[c] if layout == "sp" else F.get(at[c], F.lit(0))
    if layout == "wkb":
        define("geolake_first", _G, "STRING", H.geohash(first("x"), first("y")))
        define("addgeohash", stored, "STRING", F.call_function("geolake_first", flat))
    else:
        define("addgeohash", stored, "STRING", H.geohash(first("x"), first("y")))
    define("geolake_code", ", ".join(f"{c} DOUBLE" for c in ("min_x", "min_y", "max_x", "max_y")), "BIGINT", _code(tree))
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in S.CELL])
    define("geolake_cell", "code BIGINT", _CELL, F.coalesce(Q.cell_struct("code"), none))
    box = F.col("b")
    define("geolake_bucket", f"b {_BOX.simpleString()}", _CELL, F.call_function("geolake_cell", F.call_function("geolake_code", box["min_x"], box["min_y"], box["max_x"], box["max_y"])))
    define("findBucket", stored, _CELL, F.when(F.col("g").isNotNull(), F.call_function("geolake_bucket", F.call_function("calculateBbox", F.col("g")))))
    _done[session] = (layout if tree is None else None, names, shared)
    return names


def _code(tree: Q.Quadtree | None) -> Column:
    path, level = Q.fit("min_x", "min_y", "max_x", "max_y")
    if tree is None:
        return F.when(level.isNotNull(), Q.code_at(path, F.least(level, F.lit(Q.BASE_LEVEL))))
    return F.call_function("geolake_locate", path, level)


def _tree_function(python, tree: Q.Quadtree | None) -> None:
    if tree is None:
        return

    def locate(paths: pa.Array, levels: pa.Array) -> pa.Array:
        known = np.asarray(levels.is_valid())
        some = lambda c: c.fill_null(0).to_numpy()
        return pa.array(tree.locate_all(some(paths), some(levels)), pa.int64(), mask=~known)

    python("geolake_locate", locate, T.LongType())


def _python_functions(python, layout: str) -> None:
    flat_kind = _arrow(S.FSP)

    def from_wkb(c: pa.Array) -> pa.Array:
        return wkb.read(c).to_arrow(flat_kind)

    def from_wkt(c: pa.Array) -> pa.Array:
        return to_layout_column(c, shapes.from_wkt, "fsp")

    def as_wkb(c: pa.Array) -> pa.Array:
        return wkb.write(c)

    def bounds(c: pa.Array) -> pa.Array:
        return wkb_bounds(c)

    def encode(c: pa.Array) -> pa.Array:
        return to_layout_column(c, "wkb", layout)

    def encode_text(c: pa.Array) -> pa.Array:
        return to_layout_column(c, shapes.from_wkt, layout)

    def contains(a: pa.Array, b: pa.Array) -> pa.Array:
        whole = lambda v: shapes.unflat(v["type"], v["x"], v["y"], v["parts"])
        return pa.array([None if o is None or i is None else shapes.contains(whole(o), whole(i)) for o, i in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    python("ST_GeomFromWKB", from_wkb, S.FSP)
    python("ST_GeomFromWKT", from_wkt, S.FSP)
    python("ST_AsWKB", as_wkb, T.BinaryType())
    python("encodeGeometryText", encode_text, S.LAYOUTS[layout])
    python("geolake_contains", contains, T.BooleanType())
    if layout == "wkb":
        python("geolake_wkb_bounds", bounds, _BOX)
    else:
        python("geolake_encode", encode, S.LAYOUTS[layout])

"""The four stored geometry layouts. All carry the cell of the quadtree that holds the row."""

from __future__ import annotations

from pyspark.sql import types as T

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = range(1, 7)
COLLECTION, CLOSE = 0, 7

CELL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")] + [T.StructField("region_code", T.LongType())])
_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
_TAIL = T.StructField("bbox_partitioning", CELL)
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

WKB = T.StructType([T.StructField("geom", T.BinaryType()), _TAIL])
SP = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("coordinates", T.ArrayType(_POINT))]))), _TAIL])
FSP = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("x", _DOUBLES), T.StructField("y", _DOUBLES), T.StructField("parts", _INTS), _TAIL])
NFSP = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("x", _DOUBLES), T.StructField("y", _DOUBLES), T.StructField("parts", _INTS), T.StructField("geometries", _INTS), _TAIL])

LAYOUTS = {"wkb": WKB, "sp": SP, "fsp": FSP, "nfsp": NFSP}

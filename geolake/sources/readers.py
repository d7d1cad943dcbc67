"""Reading spatial files: GeoJSON lines, Parquet, CSV and coordinate columns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geolake import schemas as S
from geolake.functions import geometry as G
from geolake.functions import shapes
from geolake.operators.codecs import _arrow, _from_flat_nfsp
from geolake.shipping import ship_package

#: Lines that decide the types of GeoJSON properties.
SAMPLE_LINES = 100


def infer_properties(lines: list[str]) -> dict[str, str]:
    """Property types by name, in order of appearance: string, bigint, double or boolean; two different ones give string.

    Nulls say nothing, objects and arrays count as string, lines that are no objects are skipped; so are names that are never set.
    """
    found: dict[str, str] = {}
    for line in lines:
        try:
            properties = json.loads(line).get("properties")
        except (ValueError, AttributeError):
            continue
        for name, v in (properties or {}).items() if isinstance(properties, dict) else ():
            if v is None:
                continue
            kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
            found[name] = kind if found.get(name, kind) == kind else "string"
    return found


def _geometry(v: Column) -> Column:
    """A GeoJSON geometry, held in a variant, as a flat struct; null for collections and unknown types."""
    get = lambda t: F.try_variant_get(v, "$.geometry.coordinates", t)
    kind = F.try_variant_get(v, "$.geometry.type", "string")
    run = lambda hole, pts: F.struct(hole.alias("hole"), pts.alias("pts"))
    no = F.lit(False)
    rings = (
        F.when(kind == "Point", F.array(run(no, F.array(get("array<double>")))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(run(no, get("array<array<double>>"))))
        .when(kind == "MultiLineString", F.transform(get("array<array<array<double>>>"), lambda r: run(no, r)))
        .when(kind == "Polygon", F.transform(get("array<array<array<double>>>"), lambda r, i: run(i > 0, r)))
        .when(kind == "MultiPolygon", F.flatten(F.transform(get("array<array<array<array<double>>>>"), lambda p: F.transform(p, lambda r, i: run(i > 0, r)))))
    )
    axis = lambda k: F.flatten(F.transform(rings, lambda r: F.transform(r["pts"], lambda p: F.get(p, F.lit(k)))))
    first = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("parts"))
    starts = F.aggregate(rings, first, lambda a, r: F.struct((a["n"] + F.size(r["pts"])).alias("n"), F.concat(a["parts"], F.array(F.when(r["hole"], -a["n"]).otherwise(a["n"]))).alias("parts")), lambda a: a["parts"])
    code = F.when(kind == "Point", S.POINT).when(kind == "LineString", S.LINE).when(kind == "Polygon", S.POLYGON).when(kind == "MultiPoint", S.MULTIPOINT).when(kind == "MultiLineString", S.MULTILINE).when(kind == "MultiPolygon", S.MULTIPOLYGON)
    parts = F.when(kind.isin("Polygon", "MultiLineString", "MultiPolygon"), starts).otherwise(F.array().cast("array<int>"))
    x, y = axis(0), axis(1)
    return F.when(code.isNotNull() & x.isNotNull() & y.isNotNull() & ~F.exists(x, lambda c: c.isNull()), G.flat_struct(code, x, y, parts))


def _collection(v: Column) -> Column:
    """A GeoJSON geometry of any type as a nested struct."""
    arrow = _arrow(S.NFSP)
    codes = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}

    def shape(g):
        if g["type"] == "GeometryCollection":
            return S.COLLECTION, [shape(m) for m in g["geometries"]]
        pair = lambda c: (c[0], c[1]) if c and not isinstance(c[0], list) else [pair(m) for m in c]
        data = pair(g["coordinates"])
        return codes[g["type"]], [data] if g["type"] == "Point" and data else data

    def one(t):
        try:
            return shapes.to_layout(shape(json.loads(t)), "nfsp")
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    def run(c: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in c.to_pylist()], arrow)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, S.NFSP)(F.try_variant_get(v, "$.geometry", "string"))


def read_geojson(spark: SparkSession, path, nested: bool = False, properties: dict[str, str] | None = None, observation: Observation | None = None) -> DataFrame:
    """Features, one a line: ``geometry`` (flat; with ``nested`` the nested struct, which holds collections, too), then the properties.

    Property types come from the first lines (:func:`infer_properties`) if they are not given. Values of another type are null, but anything
    becomes text where a string is expected. Lines that are no feature or have no readable geometry are left out; ``observation``
    counts them as ``bad_rows``.
    """
    ship_package(spark)
    lines = spark.read.text(path)
    if properties is None:
        properties = infer_properties([r.value for r in lines.limit(SAMPLE_LINES).collect()])
    v = F.col("__v")
    rows = lines.select(F.try_parse_json("value").alias("__v"))
    flat = _geometry(v)
    if nested:
        collection = F.try_variant_get(v, "$.geometry.type", "string") == "GeometryCollection"
        geometry = F.when(collection, _collection(v)).when(flat.isNotNull(), _from_flat_nfsp(flat))
    else:
        geometry = flat
    feature = F.try_variant_get(v, "$.type", "string") == "Feature"

    def value(name: str, kind: str) -> Column:
        key = "$.properties['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        if kind == "string":
            return F.try_variant_get(v, key, "string")
        is_number = F.schema_of_variant(F.try_variant_get(v, key, "variant"))
        own = {"boolean": ("BOOLEAN",), "bigint": None, "double": None}[kind]
        got = F.try_variant_get(v, key, kind if kind == "boolean" else "double" if kind == "double" else "decimal(38,10)")
        if kind == "bigint":
            got = F.when(~is_number.isin("STRING", "BOOLEAN"), F.coalesce(got, F.try_variant_get(v, key, "double").cast("decimal(38,10)")).cast("bigint"))
        return F.when(is_number.isin(*own), got) if own else F.when(~is_number.isin("STRING", "BOOLEAN"), got)

    out = rows.select(F.when(feature, geometry).alias("geometry"), *[value(n, k).alias(n) for n, k in properties.items()])
    if observation is not None:
        out = out.observe(observation, F.count_if(F.col("geometry").isNull()).alias("bad_rows"))
    return out.where(F.col("geometry").isNotNull())


def read_spatial(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by extension, whatever its case: .json, .geojson, .ndjson, .parquet, .csv; directories and globs of those, too."""
    name = path.rstrip("/*").lower()
    if name.endswith((".json", ".geojson", ".ndjson")):
        return read_geojson(spark, path, **options)
    if name.endswith(".parquet"):
        return spark.read.options(**options).parquet(path)
    if name.endswith(".csv"):
        return spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path)
    raise ValueError(f"unknown kind of file: {path}")


def points_from_xy(df: DataFrame, x: str, y: str, codec, name: str = "geometry", keep_columns: bool = False) -> DataFrame:
    """Points of two coordinate columns; rows without both are left out."""
    point = codec.from_xy(F.col(x), F.col(y)).alias(name)
    return df.select(point, *(df.columns if keep_columns else [])).where(F.col(name).isNotNull())

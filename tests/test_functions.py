import json
import math

import pytest
from pyspark.sql import functions as F

from geolake.functions import geohash as H
from geolake.functions import geometry as G
from geolake.functions import shapes
from geolake.functions.bits import gather_bits, spread_bits
from geolake.operators.codecs import CODECS, collection_members, nested_text, nested_valid, parse
from geolake.operators.quadtree import Quadtree
from geolake.plans.sql import register_functions
from tests.helpers import box_fit
from tests.test_shapes import HOLED

WKTS = ["POINT(1 2)", "MULTIPOINT((0 0),(1 1),(2 0))", "LINESTRING(0 0,1 1,2 0)", "MULTILINESTRING((0 0,1 1),(2 2,3 3,4 4))", HOLED, f"MULTIPOLYGON({HOLED[7:]},((10 10,12 10,12 12,10 10)))", "LINESTRING EMPTY", None, "no geometry", "GEOMETRYCOLLECTION(POINT(1 2))"]


@pytest.fixture(scope="module")
def shapes_df(spark):
    return spark.createDataFrame(list(enumerate(WKTS)), "id int, wkt string").withColumn("g", parse("wkt", "wkt")).cache()


def values(df, **columns):
    return [r.asDict() for r in df.orderBy("id").select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_measures(shapes_df):
    got = values(shapes_df, area=G.st_area("g"), length=G.st_length("g"), n=G.num_points("g"), m=G.st_num_geometries("g"), box=G.bbox("g"), c=G.st_as_text(G.st_centroid("g")))
    assert [r["area"] for r in got] == [0, 0, 0, 0, 15, 17, 0, None, None, None]
    assert [r["length"] and round(r["length"], 6) for r in got[:7]] == [0, 0, round(2 * math.sqrt(2), 6), round(3 * math.sqrt(2), 6), 0, 0, 0]
    assert [r["n"] for r in got[:7]] == [1, 3, 3, 5, 10, 14, 0] and [r["m"] for r in got[:7]] == [1, 3, 1, 2, 1, 2, 0]
    assert tuple(got[5]["box"]) == (0, 0, 12, 12) and tuple(got[6]["box"]) == (None,) * 4
    assert got[0]["c"] == "POINT (1 2)" and got[1]["c"].startswith("POINT (1 0.333") and got[2]["c"] == "POINT (1 0.5)" and got[6]["c"] is None
    x, y = map(float, got[4]["c"][7:-1].split())
    assert (round(x, 9), round(y, 9)) == (round((16 * 2 - 1.5) / 15, 9),) * 2


def test_accessors(shapes_df):
    got = values(shapes_df, x=G.st_x("g"), p=G.st_x(G.st_point_n("g", -1)), s=G.st_y(G.start_point("g")), e=G.st_y(G.end_point("g")), line=G.st_as_text(G.line_from_multipoint("g")), gj=G.st_as_geojson("g"))
    assert got[0]["x"] == 1 and got[1]["x"] is None and got[2]["p"] == 2 and got[1]["p"] is None
    assert (got[4]["s"], got[4]["e"]) == (0, 1) and got[6]["s"] is None
    assert got[1]["line"] == "LINESTRING (0 0, 1 1, 2 0)" and got[2]["line"] is None
    assert json.loads(got[5]["gj"])["coordinates"][1] == [[[10, 10], [12, 10], [12, 12], [10, 10]]]
    assert json.loads(got[4]["gj"]) == {"type": "Polygon", "coordinates": [[[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}
    assert json.loads(got[0]["gj"]) == {"type": "Point", "coordinates": [1, 2]}


@pytest.mark.parametrize("name", CODECS)
def test_codecs_round_trip(shapes_df, name):
    c = CODECS[name]
    staged = shapes_df.where("id < 7").withColumn("e", c.encode("g")).withColumn("d", c.decode("e")).withColumn("b", c.bbox("e"))
    for r in staged.select("*", G.bbox("g").alias("want"), G.st_area("g").alias("a"), G.st_area("d").alias("a2")).collect():
        assert r.b == r.want and r.a == r.a2
        if name == "sp" and r.id in (4, 5):  # shells counter-clockwise, holes clockwise
            assert r.d["type"] == r.g["type"] and r.d["parts"] == r.g["parts"] and sorted(zip(r.d["x"], r.d["y"])) == sorted(zip(r.g["x"], r.g["y"]))
            assert [(p.x, p.y) for p in r.e["parts"][0].coordinates] == [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)] and [(p.x, p.y) for p in r.e["parts"][1].coordinates] == [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
        else:
            assert r.d == r.g
    for source, text in (("wkb", G.st_as_wkb("g")), ("wkt", G.st_as_text("g"))):
        direct = shapes_df.where("id < 7").withColumn("t", text).cache()
        both = direct.withColumn("e", c.encode("t", source)).withColumn("f", c.encode("g")).collect()
        assert all(r.e == r.f for r in both) or name == "wkb"
        assert direct.withColumn("e", c.encode("t", source)).withColumn("d", c.decode("e")).where("id < 4 and d.x != g.x").count() == 0
    assert c.schema.simpleString() == shapes_df.select(c.encode("g").alias("e")).schema["e"].dataType.simpleString()


def test_nested_collections(spark, shapes_df):
    text = "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1)), MULTIPOINT ((5 5)))"
    df = spark.createDataFrame([(1, text), (2, "GEOMETRYCOLLECTION EMPTY"), (3, "POINT (7 8)")], "id int, wkt string").withColumn("g", CODECS["nfsp"].encode("wkt", "wkt"))
    got = values(df, t=nested_text("g"), v=nested_valid("g"), n=F.size(collection_members("g")), bad=nested_valid(F.col("g").withField("parts", F.array(F.lit(0)))))
    assert [(r["t"], r["v"], r["n"]) for r in got] == [(text, True, 3), ("GEOMETRYCOLLECTION EMPTY", True, 0), ("POINT (7 8)", True, 1)] and not got[0]["bad"]


def test_precision_and_errors(spark):
    df = spark.createDataFrame([(1, "POINT(0.1 0.2)"), (2, "POINT(")], "id int, w string")
    assert values(df.withColumn("g", parse("w", "wkt", precision="single")), x=G.st_x("g"))[0]["x"] == pytest.approx(0.10000000149011612, abs=0)
    assert values(df, x=parse("w", "wkt"))[1]["x"] is None
    with pytest.raises(Exception):
        df.select(parse("w", "wkt", on_error="raise")).collect()


def test_geohash(spark):
    df = spark.createDataFrame([(1, 10.40744, 57.64911), (2, 181.0, 0.0), (3, None, 1.0), (4, 180.0, 90.0), (5, -180.0, -90.0)], "id int, x double, y double")
    got = values(df, h=H.geohash("x", "y"), n=H.geohash_long(H.geohash("x", "y")), b=H.geohash_bits("x", "y"), i=H.geohash_int(H.geohash("x", "y")), j=H.geohash_numeric("x", "y"), odd=H.geohash("x", "y", 5))
    assert [r["h"] for r in got] == ["u4pruydq", None, None, "zzzzzzzz", "00000000"]
    assert all(r["n"] == r["b"] and r["i"] == r["j"] for r in got) and got[0]["odd"] == "u4pru"
    value = 0
    for c in "u4pruydq":
        value = value * 32 + H.ALPHABET.index(c)
    assert got[0]["n"] == value and got[0]["i"] == (value & 0xFFFFFFFF) - (1 << 32 if value & 0x80000000 else 0)
    assert values(df, e=H.geohash_int(F.lit("a!")), f=H.geohash_long(F.lit("")))[0] == {"e": None, "f": None}


def test_bits(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1, 2**22 - 1, 0b101101])], "id int, v long")
    for r in values(df, v=F.col("v"), s=spread_bits(F.col("v"), 22), g=gather_bits(spread_bits(F.col("v"), 22), 22)):
        assert r["g"] == r["v"] and r["s"] == int("".join("0" + b for b in f"{r['v']:b}"), 2)


def test_spheroid_area(spark):
    df = spark.range(1).withColumnRenamed("id", "id")
    octant = G.flat_struct(F.lit(3), F.array(*map(F.lit, (0.0, 90.0, 90.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 89.9999999, 89.9999999, 0.0))), F.array(F.lit(0)))
    small = G.st_polygon_from_envelope(13.0, 52.0, 13.001, 52.001)
    got = values(df, o=G.st_area_spheroid(octant), s=G.st_area_spheroid(small), none=G.st_area_spheroid(G.st_point(F.lit(1), F.lit(2))))[0]
    assert got["o"] == pytest.approx(510065621724088.44 / 8, rel=1e-6)  # the ellipsoid's surface
    a, e2 = 6378137.0, G._E2
    lat = math.radians(52.0005)
    m, n = a * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5, a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    assert got["s"] == pytest.approx(m * n * math.cos(lat) * math.radians(0.001) ** 2, rel=1e-5) and got["none"] == 0


def test_contains_paths(spark):
    box = G.Envelope(0.0, 0.0, 4.0, 4.0)
    wkts = ["POINT(1 1)", "POINT(0 1)", "LINESTRING(0 0,4 4)", "LINESTRING(0 0,0 4)", "POLYGON((0 0,4 0,4 4,0 4,0 0))", "POINT(5 5)"]
    df = spark.createDataFrame(list(enumerate(wkts)), "id int, w string").withColumn("g", parse("w", "wkt"))
    got = values(df, fast=G.st_contains(box, "g"), slow=G.st_contains(box.polygon(), F.col("g")), within=G.st_within("g", box.polygon()))
    assert [r["fast"] for r in got] == [True, False, True, False, True, False] == [r["slow"] for r in got] == [r["within"] for r in got]


@pytest.mark.parametrize("layout", CODECS)
def test_sql_functions(spark, layout):
    names = register_functions(spark, layout)
    assert {"encodeGeometry", "decodeGeometry", "calculateBbox", "findBucket", "addgeohash", "multiPointToLine", "createPointGeometry", "geoNum", "ST_Contains"} <= set(names)
    text = "SELECT ST_AsText(decodeGeometry(e)) AS t, calculateBbox(e) AS b, findBucket(e).region_code AS c, addgeohash(e) AS h, w FROM (SELECT e, hex(ST_AsWKB(ST_GeomFromWKT(w))) AS w FROM (SELECT encodeGeometryText(w) AS e, w FROM VALUES ('LINESTRING(0 0,1 1,2 0)'), (NULL), ('LINESTRING EMPTY') t(w)))"
    r, none, empty = spark.sql(text).collect()
    assert r.t == "LINESTRING (0 0, 1 1, 2 0)" and tuple(r.b) == (0, 0, 2, 1) and r.c == 319 and len(r.h) == 8 and r.w == shapes.to_wkb((2, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])).hex().upper()
    assert (none.t, none.c, none.h, none.w) == (None,) * 4 and empty.t == "LINESTRING EMPTY" and empty.c is None and empty.h is None
    r = spark.sql("SELECT ST_X(decodeGeometry(createPointGeometry(3D, 4D))) AS x, createPointGeometry(NULL, 1D) AS n, ST_Area(ST_PolygonFromEnvelope(0D, 0D, 2D, 3D)) AS a, geoNum(10.40744D, 57.64911D) AS g, ST_Distance(ST_Point(0D, 0D), ST_Point(3D, 4D)) AS d, ST_XMax(ST_GeomFromWKT('MULTIPOINT((1 1),(5 2))')) AS m, ST_Length(multiPointToLine(ST_GeomFromWKT('MULTIPOINT((0 0),(3 4))'))) AS l, ST_Contains(ST_PolygonFromEnvelope(0D, 0D, 2D, 3D), ST_Point(1D, 1D)) AS c, ST_Within(ST_GeomFromWKT('LINESTRING(0 0,1 1)'), ST_PolygonFromEnvelope(0D, 0D, 2D, 3D)) AS w, ST_AreaSpheroid(ST_PolygonFromEnvelope(13D, 52D, 13.001D, 52.001D)) AS s, ST_InBox(ST_Point(1D, 1D), 0D, 0D, 2D, 2D) AS i, ST_AsText(ST_Centroid(ST_PolygonFromEnvelope(0D, 0D, 2D, 3D))) AS z, ST_AsText(ST_Centroid(ST_GeomFromWKT('LINESTRING(0 0,2 4)'))) AS y, ST_X(ST_PointN(ST_GeomFromWKT('LINESTRING(7 0,2 4)'), -2)) AS q").first()
    assert r.x == 3 and r.n is None and (r.a, r.d, r.m, r.l, r.c, r.w, r.i, r.z, r.y, r.q) == (6, 5, 5, 5, True, True, True, "POINT (1 1.5)", "POINT (1 2)", 7)
    native = spark.range(1).select(H.geohash_numeric(F.lit(10.40744), F.lit(57.64911)).alias("g"), G.st_area_spheroid(G.st_polygon_from_envelope(13.0, 52.0, 13.001, 52.001)).alias("s")).first()
    assert r.g == native.g and r.s == native.s
    spark.sql("SELECT encodeGeometry(unhex(w)) AS e FROM VALUES ('{}'), ('00') t(w)".format(shapes.to_wkb((3, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]])).hex())).createOrReplaceTempView("stored")
    got = spark.sql("SELECT ST_Area(decodeGeometry(e)) AS a FROM stored").collect()
    assert [x.a for x in got] == [8.0, None]
    tree = Quadtree.initial()
    tree.split |= {319, 1279}
    register_functions(spark, layout, tree)
    assert [x.c for x in spark.sql("SELECT findBucket(createPointGeometry(x, 1D)).region_code AS c FROM VALUES (1D), (20D), (200D) t(x)").collect()] == [tree.locate(*box_fit(x, 1, x, 1)) for x in (1, 20, 200)]
    register_functions(spark, "fsp")


def test_sql_bodies_stay_in_the_plan(spark):
    """No Python step, and only the nested columns in use are read."""
    register_functions(spark, "fsp")
    spark.range(10).select(G.st_point(F.col("id") * 1.5, F.lit(2.0)).alias("geometry")).write.mode("overwrite").parquet(str(spark.conf.get("spark.sql.warehouse.dir")) + "/sql_points")
    spark.read.parquet(str(spark.conf.get("spark.sql.warehouse.dir")) + "/sql_points").createOrReplaceTempView("sql_points")
    plan = spark.sql("SELECT findBucket(geometry).region_code AS c, count(*) FROM sql_points WHERE ST_X(geometry) > 3 AND ST_Contains(ST_PolygonFromEnvelope(0D, 0D, 9D, 9D), geometry) IS NOT NULL GROUP BY 1")
    assert plan.count() > 0
    text = spark.sql("SELECT sum(ST_X(geometry)), max(ST_XMax(geometry)) FROM sql_points")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "struct<type:int,x:array<double>>" in text


def test_point_in_polygon_equals_the_plain_predicate(spark):
    import random

    r = random.Random(5)
    outer = ["POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1))", "MULTIPOLYGON(((0 0,2 0,1 2,0 0)),((2 2,4 2,4 4,2 4,2 2),(2.5 2.5,2.5 3.5,3.5 3.5,3.5 2.5,2.5 2.5)))", "POLYGON((0 0,4 4,4 0,0 4,0 0))", "POLYGON EMPTY", "LINESTRING(0 0,4 4)", None]
    dots = [f"POINT({x} {y})" for x in range(-1, 6) for y in range(-1, 6)] + [f"POINT({r.uniform(0, 4)} {r.uniform(0, 4)})" for _ in range(60)] + ["POINT EMPTY", None]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in outer for b in dots)], "id int, a string, b string")
    df = df.withColumn("g", parse("a", "wkt")).withColumn("p", parse("b", "wkt"))
    for row in df.select("a", "b", G.st_contains("g", "p").alias("c"), G.st_contains("g", "p", points=True).alias("d")).collect():
        want = shapes.contains(shapes.from_wkt(row.a), shapes.from_wkt(row.b)) if row.a and row.b else None
        assert row.c == row.d == want, row


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("POINT(0 0)", "POINT(3 4)", 5),
        ("POINT(0 0)", "LINESTRING(1 -1,1 1)", 1),
        ("POINT(5 5)", "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,4 6,6 6,6 4,4 4))", 1),
        ("POINT(1 1)", "POLYGON((0 0,10 0,10 10,0 10,0 0))", 0),
        ("POLYGON((0 0,1 0,1 1,0 1,0 0))", "POLYGON((4 5,5 5,5 6,4 6,4 5))", 5),
        ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", 0),
        ("LINESTRING(0 0,2 0)", "LINESTRING(0 1,2 1)", 1),
        ("MULTIPOINT((0 0),(9 9))", "MULTIPOLYGON(((8 8,10 8,10 10,8 10,8 8)))", 0),
        ("MULTILINESTRING((0 0,1 0),(5 5,6 5))", "POINT(6 7)", 2),
        ("LINESTRING EMPTY", "POINT(1 1)", None),
    ],
)
def test_distance(spark, a, b, want):
    register_functions(spark, "fsp")
    text = "SELECT ST_Distance(ST_GeomFromWKT({}), ST_GeomFromWKT({})) AS d"
    assert [spark.sql(text.format(repr(x), repr(y))).first().d for x, y in ((a, b), (b, a))] == [want, want]

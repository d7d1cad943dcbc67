"""The registered spatial queries, with the SQL each is held against.

The driver's tables have no coordinates, so points, rectangles and boxes are derived from keys by expressions that give the same
values in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolake.functions import geohash as H
from geolake.functions import geometry as G
from geolake.operators import joins
from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS
from geolake.plans.table import GeoTable, TableSpec
from geolake.shipping import ship_package
from geolake.sources.convert import cells_geojson

WORLD = """select l_orderkey as k, l_linenumber as n,
  ((l_orderkey*7919+l_linenumber*104729)%360000)/cast(1000 as double)-180 as lon,
  ((l_orderkey*15485863+l_linenumber*32452843)%180000)/cast(1000 as double)-90 as lat from lineitem"""
CITY = """select l_orderkey as k, l_linenumber as n,
  ((l_orderkey*7919+l_linenumber*104729)%3000)/cast(10000 as double)-74.1 as lon,
  ((l_orderkey*15485863+l_linenumber*32452843)%4000)/cast(10000 as double)+40.6 as lat from lineitem"""
RECTS = """select p_partkey as id, ((p_partkey*7919)%6000)/cast(10000 as double)-74.2 as x0,
  ((p_partkey*104729)%5000)/cast(10000 as double)+40.45 as y0,
  (1+p_size)*cast(0.0002 as double) as w, (1+p_size%7)*cast(0.0001 as double) as h from part"""
CELLS = """select n_nationkey as cid, n_name as name, cast(-180+72*(n_nationkey%5) as double) as xmin,
  cast(-90+36*((n_nationkey-n_nationkey%5)/5) as double) as ymin,
  cast(-108+72*(n_nationkey%5) as double) as xmax,
  cast(-54+36*((n_nationkey-n_nationkey%5)/5) as double) as ymax from nation"""
BOX = (-74.02, 40.70, -73.90, 40.88)
YARD = (-74.26, 40.47, -73.70, 40.91)
TREE_ROWS = 2_000


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    ship_package(spark)
    table = text.rsplit(" ", 1)[1]
    return spark.sql(text.rsplit(" ", 1)[0] + " {t}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _points(spark, sf_dir, text=WORLD) -> DataFrame:
    return view(spark, sf_dir, text).select("k", "n", G.st_point("lon", "lat").alias("geometry"))


def _tracks(spark, sf_dir) -> DataFrame:
    """One multipoint for each order, in the order of its lines."""
    rows = view(spark, sf_dir, CITY).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "lon", "lat"))).alias("p"))
    return rows.select("k", G.multipoint(F.col("p")["lon"], F.col("p")["lat"]).alias("geometry"))


def _rects(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, RECTS).select("id", G.st_polygon_from_envelope("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("geometry"))


def _holed(spark, sf_dir) -> DataFrame:
    r = view(spark, sf_dir, RECTS)
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return r.select("id", G.polygon_with_hole(x0, y0, x0 + w, y0 + h, x0 + w / 4, y0 + h / 4, x0 + w * 3 / 4, y0 + h * 3 / 4).alias("geometry"))


_tables: dict[tuple, GeoTable] = {}


def city_table(spark: SparkSession, sf_dir: str, layout: str = "fsp") -> GeoTable:
    """An indexed table of the city points, built once for each application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _tables:
        name = "_".join([sf_dir.strip("/").replace("/", "_").replace(":", "_").replace(".", "_"), layout, spark.sparkContext.applicationId])
        t = GeoTable(spark, TableSpec("geolake_queries", name, spark.conf.get("spark.sql.warehouse.dir")), layout)
        if not t.exists():
            rows = _points(spark, sf_dir, CITY)
            t.append_indexed(rows.withColumn("geometry", CODECS[layout].encode("geometry")), driver_rows=2_000_000, max_rows=TREE_ROWS)
        _tables[key] = t
    return _tables[key]


def xy_points_fsp(spark, sf_dir):
    p = _points(spark, sf_dir)
    g = F.col("geometry")
    return p.select("k", "n", g["type"].alias("type"), g["x"][0].alias("x"), g["y"][0].alias("y"), F.size(g["parts"]).alias("n_parts"))


def quad_code_depth4(spark, sf_dir):
    return view(spark, sf_dir, WORLD).groupBy(Q.point_code("lon", "lat").alias("code")).agg(F.count("*").alias("cnt"))


def quad_parent_rollup(spark, sf_dir):
    code = Q.point_code("lon", "lat")
    return view(spark, sf_dir, WORLD).select(code.alias("code"), Q.parent(code).alias("parent")).rollup("parent", "code").agg(F.count("*").alias("cnt"))


def quad_box_codes(spark, sf_dir):
    b = G.bbox("geometry")
    code = Q.quad_code(b["min_x"], b["min_y"], b["max_x"], b["max_y"], 12)
    return _rects(spark, sf_dir).select(code.alias("code")).groupBy("code").agg(F.count("*").alias("cnt"))


def quad_adaptive_counts(spark, sf_dir):
    p = view(spark, sf_dir, CITY).withColumn("b", F.struct(F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y")))
    tree = Q.build_tree(p, F.col("b"), driver_rows=10_000_000, max_rows=TREE_ROWS)
    return Q.assign(p, F.col("b"), tree).groupBy(F.col("region_code").alias("code")).agg(F.count("*").alias("cnt"))


def _outside(x, y) -> Column:
    return (x < BOX[0]) | (x > BOX[2]) | (y < BOX[1]) | (y > BOX[3])


def _first(c="geometry"):
    return F.col(c)["x"][0], F.col(c)["y"][0]


def window_count_outside(spark, sf_dir):
    return _points(spark, sf_dir, CITY).where(_outside(*_first())).agg(F.count("*").alias("cnt"))


def window_count_outside_indexed(spark, sf_dir):
    return city_table(spark, sf_dir).window(*BOX, outside=True).where(_outside(*_first())).agg(F.count("*").alias("cnt"))


def window_count_inside(spark, sf_dir):
    return _points(spark, sf_dir, CITY).where(~_outside(*_first())).agg(F.count("*").alias("cnt"))


def window_count_inside_indexed(spark, sf_dir):
    return city_table(spark, sf_dir).window(*BOX).where(~_outside(*_first())).agg(F.count("*").alias("cnt"))


def _decode_sum(layout):
    def query(spark, sf_dir):
        codec = CODECS[layout]
        p = _points(spark, sf_dir, CITY).select(codec.decode(codec.encode("geometry")).alias("g"))
        return p.agg(F.round(F.sum(G.st_x("g") - G.st_y("g")), 3).alias("diff"))

    return query


def _window_layout(layout):
    def query(spark, sf_dir):
        t = city_table(spark, sf_dir, layout)
        g = t.decoded(t.window(*BOX))
        return g.where(~_outside(G.st_x("geom"), G.st_y("geom"))).agg(F.count("*").alias("cnt"), F.round(F.sum(G.st_x("geom") + G.st_y("geom")), 3).alias("total"))

    return query


def trajectory_line_filter(spark, sf_dir):
    t = _tracks(spark, sf_dir).withColumn("geom", G.line_from_multipoint("geometry"))
    p = G.st_point_n("geom", 1)
    return t.where(G.st_x(p).between(BOX[0], BOX[2]) & G.st_y(p).between(BOX[1], BOX[3]) & (G.st_length("geom") > 0.1)).agg(F.count("*").alias("cnt"))


def trajectory_length(spark, sf_dir):
    return _tracks(spark, sf_dir).select("k", F.round(G.st_length(G.line_from_multipoint("geometry")), 9).alias("length"))


def bbox_diagonal_avg(spark, sf_dir):
    g = "geometry"
    d = G.st_distance(G.st_point(G.st_x_min(g), G.st_y_min(g)), G.st_point(G.st_x_max(g), G.st_y_max(g)))
    return _tracks(spark, sf_dir).agg(F.round(F.avg(d), 9).alias("diagonal"))


def box_contains_area(spark, sf_dir):
    r = _rects(spark, sf_dir).where(G.st_contains(G.Envelope(*YARD), "geometry"))
    return r.agg(F.count("*").alias("cnt"), F.round(F.sum(G.st_area("geometry")), 6).alias("area"))


def area_spheroid_rect(spark, sf_dir):
    r = _rects(spark, sf_dir).where(G.st_contains(G.Envelope(*YARD), "geometry"))
    return r.agg(F.count("*").alias("cnt"), F.round(F.sum(G.st_area_spheroid("geometry")), 0).alias("area"))


def holed_area(spark, sf_dir):
    return _holed(spark, sf_dir).agg(F.round(F.sum(G.st_area("geometry")), 6).alias("area"))


def bbox_in_box_count(spark, sf_dir):
    b = G.bbox("geometry")
    inside = (b["min_x"] >= BOX[0]) & (b["max_x"] <= BOX[2]) & (b["min_y"] >= BOX[1]) & (b["max_y"] <= BOX[3])
    return _rects(spark, sf_dir).where(inside).agg(F.count("*").alias("cnt"))


def vertex_count_sum(spark, sf_dir):
    return _tracks(spark, sf_dir).agg(F.sum(G.num_points("geometry")).alias("vertices"))


def geohash8_group(spark, sf_dir):
    return _points(spark, sf_dir, CITY).groupBy(H.geometry_geohash("geometry").alias("geohash")).agg(F.count("*").alias("cnt"))


def geohash_numeric(spark, sf_dir):
    p = view(spark, sf_dir, WORLD)
    return p.select("k", "n", H.geohash_numeric("lon", "lat").alias("num"), H.geohash_long(H.geohash("lon", "lat", 6)).alias("num6"), H.geohash_int(H.geohash("lon", "lat")).alias("again"))


def geohash_sorted_topk(spark, sf_dir):
    p = view(spark, sf_dir, CITY).select("k", "n", H.geohash("lon", "lat").alias("geohash"))
    return p.orderBy("geohash", "k", "n").limit(100)


def region_histogram(spark, sf_dir):
    return city_table(spark, sf_dir).df().select(F.col("geometry.bbox_partitioning.*")).groupBy("region_code", "min_x", "min_y", "max_x", "max_y").agg(F.count("*").alias("cnt"))


def spatial_join_points_cells(spark, sf_dir):
    """Theta join on half-open boxes: the 25 boxes are one broadcast."""
    p, c = view(spark, sf_dir, WORLD), view(spark, sf_dir, CELLS)
    inside = (F.col("lon") >= F.col("xmin")) & (F.col("lon") < F.col("xmax")) & (F.col("lat") >= F.col("ymin")) & (F.col("lat") < F.col("ymax"))
    return p.join(F.broadcast(c), inside).groupBy("cid").agg(F.count("*").alias("cnt"))


def _places(spark, sf_dir):
    """Each distinct point of the city once, with the number of its rows and the sum of their keys."""
    p = view(spark, sf_dir, CITY).groupBy("lon", "lat").agg(F.count("*").alias("cnt"), F.sum("k").alias("keys"))
    return p.select("cnt", "keys", G.st_point("lon", "lat").alias("geometry"))


def spatial_join_within(spark, sf_dir):
    """All points within all rectangles, dealt by grid cell; rows at one place are joined once and counted."""
    return joins.spatial_join(_places(spark, sf_dir), _rects(spark, sf_dir), "geometry", "geometry", "within").groupBy("id").agg(F.sum("cnt").alias("cnt"))


def _in_rects(spark, sf_dir, how):
    p = joins.spatial_join(_places(spark, sf_dir), _rects(spark, sf_dir), "geometry", "geometry", "within", how)
    return p.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.sum("keys").alias("keys"))


def spatial_semi_join(spark, sf_dir):
    return _in_rects(spark, sf_dir, "left_semi")


def spatial_anti_join(spark, sf_dir):
    return _in_rects(spark, sf_dir, "left_anti")


def union_start_end(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    ends = t.select("k", G.start_point("geometry").alias("p")).unionByName(t.select("k", G.end_point("geometry").alias("p")))
    return ends.groupBy(Q.point_code(F.col("p")["x"][0], F.col("p")["y"][0], 12).alias("code")).agg(F.count("*").alias("cnt"))


def geojson_props_infer(spark, sf_dir):
    """Events as features, their properties typed by the first lines in order of the id."""
    from geolake.sources.readers import read_geojson

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = f"{spark.conf.get('spark.sql.warehouse.dir')}/geolake_features_{spark.sparkContext.applicationId}"
    key = ("features", spark.sparkContext.applicationId, sf_dir)
    path = f"{out}/{abs(hash(sf_dir))}.geojson"
    if key not in _tables:
        line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col("event_id") % 180, F.lit(","), F.col("event_id") % 90, F.lit(']},"properties":'), F.col("props"), F.lit("}"))
        e.select(line.alias("value")).write.mode("overwrite").text(path)
        _tables[key] = True
    features = read_geojson(spark, path)
    names = [c for c in features.columns if c != "geometry"]
    return features.groupBy(*names).agg(F.count("*").alias("cnt"), F.sum(G.st_x("geometry")).alias("xs"))


def ndjson_convert(spark, sf_dir):
    """Nations as one feature collection, then as lines again."""
    from geolake.sources.convert import feature_lines

    c = view(spark, sf_dir, CELLS)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("xmin", "ymin").alias("coordinates")).alias("geometry"), F.struct("cid", "name").alias("properties"))
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/geolake_collection_{spark.sparkContext.applicationId}"
    c.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return feature_lines(spark, path).select(F.get_json_object("value", "$.properties.cid").cast("long").alias("cid"), F.get_json_object("value", "$.properties.name").alias("name"), F.get_json_object("value", "$.geometry.coordinates[0]").cast("double").alias("x"))


def _index_table(spark, sf_dir, name):
    import uuid

    t = GeoTable(spark, TableSpec("geolake_queries", f"{name}_{uuid.uuid4().hex}", spark.conf.get("spark.sql.warehouse.dir")), "fsp")
    p = _points(spark, sf_dir, CITY)
    t.append_indexed(p.where("n % 2 = 0"), driver_rows=10_000_000, max_rows=TREE_ROWS)
    t.append(p.where("n % 2 = 1"))
    return t


def _odd_rows(spark, sf_dir):
    """Empty lines, null geometries and points beyond the world, one of each for each supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    none = F.array().cast("array<double>")
    empty = G.flat_struct(F.lit(2), none, none, F.array().cast("array<int>"))
    kinds = [empty, F.lit(None).cast(empty_type()), G.st_point(F.lit(300.0), F.lit(1.0))]
    out = None
    for i, g in enumerate(kinds):
        rows = s.select("k", F.lit(-i).alias("n"), g.alias("geometry"))
        out = rows if out is None else out.unionByName(rows)
    return out


def empty_type():
    from geolake import schemas

    return schemas.FSP


def reindex_new_rows(spark, sf_dir):
    """Half of the points are indexed at once, half later, with empty, null and far geometries among both."""
    t = _index_table(spark, sf_dir, "reindex")
    odd = _odd_rows(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in t.df().drop("region_code").schema])
    t.append(odd)
    t.add_index_to_new_rows(driver_rows=10_000_000, max_rows=TREE_ROWS)
    t.append_indexed(odd, driver_rows=10_000_000, max_rows=TREE_ROWS)
    t.compact()
    inside = t.df().where(~_outside(F.get("geometry.x", F.lit(0)), F.get("geometry.y", F.lit(0))))
    near = t.window(*BOX).where(~_outside(F.get("geometry.x", F.lit(0)), F.get("geometry.y", F.lit(0))))
    rows = t.df().agg(F.count("*").alias("all_rows"), F.count_if(F.col("region_code").isNull()).alias("no_cell"), F.count_if(F.col("region_code") == 1).alias("beyond"))
    return rows.crossJoin(inside.agg(F.count("*").alias("cnt"))).crossJoin(near.agg(F.count("*").alias("found")))


def rebuild_index(spark, sf_dir):
    t = _index_table(spark, sf_dir, "rebuild")
    t.rebuild_index(driver_rows=10_000_000, max_rows=TREE_ROWS)
    return t.partitions().select(F.col("region_code").alias("code"), F.col("count").alias("cnt"))


def parts_offsets_polygon(spark, sf_dir):
    h = _holed(spark, sf_dir)
    n = CODECS["nfsp"].encode("geometry")
    return h.select("id", F.array_join(F.col("geometry.parts").cast("array<string>"), ",").alias("flat"), F.array_join(n["parts"].cast("array<string>"), ",").alias("nested"), F.array_join(n["geometries"].cast("array<string>"), ",").alias("tokens"))


def sp_roundtrip(spark, sf_dir):
    sp = CODECS["sp"]
    h = _holed(spark, sf_dir).select("id", sp.decode(sp.encode("geometry")).alias("g"))
    return h.select("id", F.size("g.x").alias("points"), F.array_join(F.col("g.parts").cast("array<string>"), ",").alias("parts"), F.round(G.st_area("g"), 12).alias("area"))


def centroid(spark, sf_dir):
    c = G.st_centroid("geometry")
    return _tracks(spark, sf_dir).select("k", F.round(G.st_x(c), 9).alias("x"), F.round(G.st_y(c), 9).alias("y"))


def polygon_centroid(spark, sf_dir):
    c = G.st_centroid("geometry")
    return _holed(spark, sf_dir).select("id", F.round(G.st_x(c), 7).alias("x"), F.round(G.st_y(c), 7).alias("y"))


def start_end_point(spark, sf_dir):
    s, e = G.start_point("geometry"), G.end_point("geometry")
    return _tracks(spark, sf_dir).select("k", G.st_x(s).alias("x1"), G.st_y(s).alias("y1"), G.st_x(e).alias("x2"), G.st_y(e).alias("y2"))


def wkt_roundtrip(spark, sf_dir):
    from geolake.operators.codecs import parse

    r = _rects(spark, sf_dir).select("id", parse(G.st_as_text("geometry"), "wkt").alias("g"))
    return r.select("id", F.col("g.type").alias("type"), G.st_x_min("g").alias("x"), G.st_y_min("g").alias("y"))


def cells_geojson_export(spark, sf_dir):
    """The corners of all exported cells, in order."""
    p = cells_geojson(view(spark, sf_dir, CELLS).orderBy("cid"))
    shape = F.from_json("value", "type string, coordinates array<array<array<array<double>>>>")["coordinates"]
    rows = p.select(F.posexplode(shape).alias("polygon", "rings")).select(F.col("polygon").cast("long"), F.posexplode(F.get("rings", F.lit(0))).alias("corner", "at"))
    return rows.select("polygon", (F.col("corner") + 1).cast("long").alias("corner"), F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))


def contains_general(spark, sf_dir):
    """A point and a line in the triangle below each rectangle's diagonal; where they are differs by rectangle."""
    r = view(spark, sf_dir, RECTS)
    x0, y0, w, h, i = (F.col(c) for c in ("x0", "y0", "w", "h", "id"))
    u, v = (i % 10 + 1) / F.lit(15.5), (i % 7 + 1) / F.lit(15.5)
    none = F.array().cast("array<int>")
    tri = G.flat_struct(F.lit(3), F.array(x0, x0 + w, x0, x0), F.array(y0, y0, y0 + h, y0), F.array(F.lit(0)))
    line = G.flat_struct(F.lit(2), F.array(x0 + w * u, x0 + w * u / 2), F.array(y0 + h * v, y0 + h * v / 2), none)
    return r.select("id", G.st_contains(tri, G.st_point(x0 + w * u, y0 + h * v)).alias("inside"), G.st_contains(tri, line).alias("line_inside"))


def cell_rollup(spark, sf_dir):
    code = Q.point_code("lon", "lat", 3)
    return view(spark, sf_dir, WORLD).select(Q.parent(code).alias("parent"), code.alias("code"), "n").rollup("parent", "code").agg(F.count("*").alias("cnt"), F.sum("n").alias("lines"))


def rank_points_in_cell(spark, sf_dir):
    p = view(spark, sf_dir, WORLD).withColumn("code", Q.point_code("lon", "lat"))
    w = Window.partitionBy("code").orderBy("lon", "lat", "k", "n")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 3").select("code", "r", "lon", "lat")


def _two_tables(spark, sf_dir):
    """Cells of all points, and cells of the lower left corners of all rectangles."""
    p, r = view(spark, sf_dir, CITY), view(spark, sf_dir, RECTS)
    return p.select(Q.point_code("lon", "lat", 12).alias("code")), r.select(Q.point_code("x0", "y0", 12).alias("code"))


def cells_intersect(spark, sf_dir):
    a, b = _two_tables(spark, sf_dir)
    return a.intersect(b)


def cells_except(spark, sf_dir):
    a, b = _two_tables(spark, sf_dir)
    return a.subtract(b)


def quad_grown_counts(spark, sf_dir):
    """A table that grows in three parts has the leaves of one that was written at once; its rows, by those leaves."""
    import uuid

    t = GeoTable(spark, TableSpec("geolake_queries", f"grown_{uuid.uuid4().hex}", spark.conf.get("spark.sql.warehouse.dir")), "fsp")
    p = _points(spark, sf_dir, CITY)
    for i in range(3):
        t.append_indexed(p.where(F.pmod(F.col("k") + F.col("n"), F.lit(3)) == i), driver_rows=10_000_000, max_rows=TREE_ROWS)
    b = G.bbox("geometry")
    rows = Q.assign(t.df().select(b.alias("b")), F.col("b"), t.tree(), "code")
    return rows.groupBy("code").agg(F.count("*").alias("cnt"))


def drop_index(spark, sf_dir):
    """After the index is dropped no row has a cell, and none is lost."""
    t = _index_table(spark, sf_dir, "drop")
    t.drop_index()
    return t.df().agg(F.count("*").alias("cnt"), F.count("region_code").alias("coded"), F.count("geometry.bbox_partitioning").alias("cells"))


def _sql(spark, text: str, **frames) -> DataFrame:
    from geolake.plans.sql import register_functions

    register_functions(spark, "fsp")
    return spark.sql(text, **frames)


def sql_point_functions(spark, sf_dir):
    """The SQL functions over stored points."""
    text = """SELECT geoNum(lon, lat) AS num, findBucket(e).region_code AS code, round(calculateBbox(e).min_x, 6) AS x, countCoordinates(decodeGeometry(e)) AS n, count(*) AS cnt
              FROM (SELECT lon, lat, createPointGeometry(lon, lat) AS e FROM {p}) GROUP BY ALL"""
    return _sql(spark, text, p=view(spark, sf_dir, WORLD))


def sql_geohash_group(spark, sf_dir):
    return _sql(spark, "SELECT addgeohash(geometry) AS geohash, count(*) AS cnt FROM {p} GROUP BY 1", p=_points(spark, sf_dir, CITY))


def sql_line_functions(spark, sf_dir):
    return _sql(spark, "SELECT k, round(ST_Length(multiPointToLine(geometry)), 9) AS length, ST_XMax(geometry) AS x, countCoordinates(geometry) AS n FROM {t}", t=_tracks(spark, sf_dir))


def sql_polygon_functions(spark, sf_dir):
    text = "SELECT id, round(ST_Area(geometry), 12) AS area, round(ST_X(ST_Centroid(geometry)), 7) AS x, ST_Contains(geometry, ST_Point(x0 + w / 2, y0 + h / 8)) AS edge, ST_Contains(geometry, ST_Point(x0 + w / 2, y0 + h / 2)) AS hole FROM {r} JOIN {v} USING (id)"
    return _sql(spark, text, r=_holed(spark, sf_dir), v=view(spark, sf_dir, RECTS))


def sql_wkb_roundtrip(spark, sf_dir):
    """Lines as WKB, encoded as a stored struct, decoded and measured."""
    text = "SELECT sum(ST_NumPoints(decodeGeometry(e))) AS points, round(sum(ST_XMin(decodeGeometry(e))), 6) AS x FROM (SELECT encodeGeometry(ST_AsWKB(geometry)) AS e FROM {t})"
    return _sql(spark, text, t=_tracks(spark, sf_dir))


def _code(level: int, x: str = "lon", y: str = "lat") -> str:
    """A point's cell code at a level, in SQL."""
    n = 1 << level
    i, j = f"CAST(greatest(ceil(({x} + 180) * {n}.0 / 360) - 1, 0) AS BIGINT)", f"CAST(least(floor(({y} + 90) * {n}.0 / 180), {n - 1}) AS BIGINT)"
    digits = " + ".join(f"((1 - (({i} >> {k}) & 1)) + 2 * (1 - (({j} >> {k}) & 1))) * {4**k}" for k in range(level))
    return f"CAST({4**level} + {digits} AS BIGINT)"


_BOXED = f"lon < {BOX[0]} OR lon > {BOX[2]} OR lat < {BOX[1]} OR lat > {BOX[3]}"
_TRACK = f"WITH p AS ({CITY}), s AS (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM p WINDOW w AS (PARTITION BY k ORDER BY n, lon, lat))"


def _geohash_sql(precision: int = 8) -> str:
    """Interleaved bits and base-32 text of lon, lat, in SQL; even precisions."""
    bits = 5 * precision // 2
    i = f"CAST(least(floor((lon + 180.0) / 360.0 * {1 << bits}), {(1 << bits) - 1}) AS BIGINT)"
    j = f"CAST(least(floor((lat + 90.0) / 180.0 * {1 << bits}), {(1 << bits) - 1}) AS BIGINT)"
    return "(" + " + ".join(f"((({i} >> {k}) & 1) * {1 << (2 * k + 1)} + (({j} >> {k}) & 1) * {1 << (2 * k)})" for k in range(bits)) + ")"


def _text_sql(bits: str, precision: int = 8) -> str:
    return " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + (({bits} >> {5 * (precision - 1 - i)}) & 31) AS INTEGER), 1)" for i in range(precision))


_ADAPTIVE = f"""
    WITH RECURSIVE p AS (SELECT *, row_number() OVER () AS r FROM ({CITY})),
    deepest AS (SELECT r, {_code(22)} AS deep FROM p),
    paths AS (SELECT r, l, deep >> (2 * (22 - l)) AS code FROM deepest, range(4, 23) t(l)),
    counts AS (SELECT l, code, code >> 2 AS parent, count(*) AS cnt FROM paths GROUP BY ALL),
    tree AS (
        SELECT l, code FROM counts WHERE l = 4
        UNION ALL
        SELECT c.l, c.code FROM tree t JOIN counts p ON p.l = t.l AND p.code = t.code AND p.cnt > {TREE_ROWS} JOIN counts c ON c.parent = t.code AND c.l = t.l + 1
    ), own AS (SELECT r, max_by(code, paths.l) AS code FROM paths JOIN tree USING (l, code) GROUP BY r)
"""
_E2, _E = G._E2, G._E


def _half(lat: str) -> str:
    s = f"sin(radians({lat}))"
    q = f"((1 - {_E2!r}) * ({s} / (1 - {_E2!r} * {s} * {s}) - ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s})) / (2 * {_E!r})) / {G._Q_POLE!r})"
    return f"({q} / (1 + sqrt(1 - {q} * {q})))"


_INSIDE = f"x0 >= {YARD[0]} AND x0 + w <= {YARD[2]} AND y0 >= {YARD[1]} AND y0 + h <= {YARD[3]}"
_RECT_BOX = f"x0 >= {BOX[0]} AND x0 + w <= {BOX[2]} AND y0 >= {BOX[1]} AND y0 + h <= {BOX[3]}"

#: Whether (u, v), in units of a rectangle's sides, is inside the triangle of contains_general.
_TRIANGLE = "({u} > 0 AND {v} > 0 AND {u} + {v} < 1)"
ORACLE_SQL = {
    "xy_points_fsp": f"SELECT k, n, 1 AS type, lon AS x, lat AS y, 0 AS n_parts FROM ({WORLD})",
    "quad_code_depth4": f"SELECT {_code(4)} AS code, count(*) AS cnt FROM ({WORLD}) GROUP BY 1",
    "quad_parent_rollup": f"SELECT parent, code, count(*) AS cnt FROM (SELECT {_code(4)} AS code, {_code(4)} >> 2 AS parent FROM ({WORLD})) GROUP BY ROLLUP (parent, code)",
    "quad_box_codes": f"""
        WITH b AS (SELECT id, unnest(range(13)) AS l, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM ({RECTS})),
        c AS (SELECT *, 360.0 / (1 << l) AS cw, 180.0 / (1 << l) AS ch FROM b),
        d AS (SELECT *, CAST(greatest(ceil((x1 + 180) / cw) - 1, 0) AS BIGINT) AS i, CAST(least(floor((y0 + 90) / ch), (1 << l) - 1) AS BIGINT) AS j FROM c),
        f AS (SELECT * FROM d WHERE x0 >= -180 + i * cw AND y1 <= -90 + (j + 1) * ch)
        SELECT code, count(*) AS cnt FROM (
            SELECT id, max_by(CAST((1 << (2 * l)) + list_sum(list_transform(range(0, l), lambda k: ((1 - ((i >> k) & 1)) + 2 * (1 - ((j >> k) & 1))) << (2 * k))) AS BIGINT), l) AS code FROM (SELECT * FROM f WHERE l > 0) GROUP BY id
        ) GROUP BY code""",
    "quad_adaptive_counts": _ADAPTIVE + "SELECT code, count(*) AS cnt FROM own GROUP BY code",
    "rebuild_index": _ADAPTIVE + "SELECT code, count(*) AS cnt FROM own GROUP BY code",
    "region_histogram": _ADAPTIVE + """
        , s AS (SELECT code, count(*) AS cnt, CAST((length(bin(code)) - 1) / 2 AS INTEGER) AS l FROM own GROUP BY code),
        g AS (SELECT *, list_sum(list_transform(range(0, l), lambda k: (1 - ((code >> (2 * k)) & 1)) << k)) AS i, list_sum(list_transform(range(0, l), lambda k: (1 - ((code >> (2 * k + 1)) & 1)) << k)) AS j FROM s)
        SELECT code AS region_code, CAST(i * (360.0::DOUBLE / (1 << l)) - 180 AS DOUBLE) AS min_x, CAST(j * (180.0::DOUBLE / (1 << l)) - 90 AS DOUBLE) AS min_y,
               CAST((i + 1) * (360.0::DOUBLE / (1 << l)) - 180 AS DOUBLE) AS max_x, CAST((j + 1) * (180.0::DOUBLE / (1 << l)) - 90 AS DOUBLE) AS max_y, cnt FROM g""",
    "window_count_outside": f"SELECT count(*) AS cnt FROM ({CITY}) WHERE {_BOXED}",
    "window_count_outside_indexed": f"SELECT count(*) AS cnt FROM ({CITY}) WHERE {_BOXED}",
    "window_count_inside": f"SELECT count(*) AS cnt FROM ({CITY}) WHERE NOT ({_BOXED})",
    "window_count_inside_indexed": f"SELECT count(*) AS cnt FROM ({CITY}) WHERE NOT ({_BOXED})",
    **{f"decode_sum_diff_{x}": f"SELECT round(sum(lon - lat), 3) AS diff FROM ({CITY})" for x in CODECS},
    **{f"window_sum_indexed_{x}": f"SELECT count(*) AS cnt, round(sum(lon + lat), 3) AS total FROM ({CITY}) WHERE NOT ({_BOXED})" for x in CODECS},
    "trajectory_line_filter": _TRACK + f""", t AS (SELECT k, count(*) AS c, sum(CASE WHEN px IS NULL THEN 0 ELSE sqrt((lon - px) ** 2 + (lat - py) ** 2) END) AS len, arg_min(lon, (n, lon, lat)) AS x, arg_min(lat, (n, lon, lat)) AS y FROM s GROUP BY k)
        SELECT count(*) AS cnt FROM t WHERE c >= 2 AND len > 0.1 AND x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]}""",
    "trajectory_length": _TRACK + "SELECT k, CASE WHEN count(*) >= 2 THEN round(sum(CASE WHEN px IS NULL THEN 0 ELSE sqrt((lon - px) ** 2 + (lat - py) ** 2) END), 9) END AS length FROM s GROUP BY k",
    "bbox_diagonal_avg": f"SELECT round(avg(d), 9) AS diagonal FROM (SELECT sqrt((max(lon) - min(lon)) ** 2 + (max(lat) - min(lat)) ** 2) AS d FROM ({CITY}) GROUP BY k)",
    "box_contains_area": f"SELECT count(*) AS cnt, round(sum(w * h), 6) AS area FROM ({RECTS}) WHERE {_INSIDE}",
    "area_spheroid_rect": f"""SELECT count(*) AS cnt, round(sum(abs(2 * atan2(tan(radians(w) / 2) * 2 * a, 1 + a * a) - 2 * atan2(tan(radians(w) / 2) * 2 * b, 1 + b * b))) * {G.AUTHALIC_RADIUS**2!r}, 0) AS area
        FROM (SELECT *, {_half('y0')} AS a, {_half('y0 + h')} AS b FROM ({RECTS}) WHERE {_INSIDE})""",
    "holed_area": f"SELECT round(sum(w * h * 3 / 4), 6) AS area FROM ({RECTS})",
    "bbox_in_box_count": f"SELECT count(*) AS cnt FROM ({RECTS}) WHERE {_RECT_BOX}",
    "vertex_count_sum": "SELECT count(*) AS vertices FROM lineitem",
    "geohash8_group": f"SELECT {_text_sql('b')} AS geohash, cnt FROM (SELECT {_geohash_sql()} AS b, count(*) AS cnt FROM ({CITY}) GROUP BY 1)",
    "geohash_numeric": f"SELECT k, n, num, num6, num AS again FROM (SELECT k, n, CAST(CASE WHEN b & 4294967295 >= 2147483648 THEN (b & 4294967295) - 4294967296 ELSE b & 4294967295 END AS INTEGER) AS num, CAST(c AS BIGINT) AS num6 FROM (SELECT k, n, {_geohash_sql()} AS b, {_geohash_sql(6)} AS c FROM ({WORLD})))",
    "geohash_sorted_topk": f"SELECT k, n, {_text_sql('b')} AS geohash FROM (SELECT k, n, {_geohash_sql()} AS b FROM ({CITY})) ORDER BY geohash, k, n LIMIT 100",
    "spatial_join_points_cells": f"SELECT cid, count(*) AS cnt FROM ({WORLD}) JOIN ({CELLS}) ON lon >= xmin AND lon < xmax AND lat >= ymin AND lat < ymax GROUP BY cid",
    "union_start_end": f"""WITH p AS ({CITY}), e AS (SELECT arg_min(lon, (n, lon, lat)) AS lon, arg_min(lat, (n, lon, lat)) AS lat FROM p GROUP BY k UNION ALL SELECT arg_max(lon, (n, lon, lat)), arg_max(lat, (n, lon, lat)) FROM p GROUP BY k)
        SELECT {_code(12)} AS code, count(*) AS cnt FROM e GROUP BY 1""",
    "geojson_props_infer": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS cnt, CAST(sum(event_id % 180) AS DOUBLE) AS xs FROM events GROUP BY 1",
    "ndjson_convert": f"SELECT CAST(cid AS BIGINT) AS cid, name, xmin AS x FROM ({CELLS})",
    "parts_offsets_polygon": f"SELECT id, '0,-5' AS flat, '0,-5,9' AS nested, '3' AS tokens FROM ({RECTS})",
    "sp_roundtrip": f"SELECT id, 10 AS points, '0,-5' AS parts, round(w * h * 3 / 4, 12) AS area FROM ({RECTS})",
    "centroid": f"SELECT k, round(avg(lon), 9) AS x, round(avg(lat), 9) AS y FROM ({CITY}) GROUP BY k",
    "polygon_centroid": f"SELECT id, round(x0 + w / 2, 7) AS x, round(y0 + h / 2, 7) AS y FROM ({RECTS})",
    "start_end_point": f"SELECT k, arg_min(lon, (n, lon, lat)) AS x1, arg_min(lat, (n, lon, lat)) AS y1, arg_max(lon, (n, lon, lat)) AS x2, arg_max(lat, (n, lon, lat)) AS y2 FROM ({CITY}) GROUP BY k",
    "wkt_roundtrip": f"SELECT id, 3 AS type, x0 AS x, y0 AS y FROM ({RECTS})",
    "cell_rollup": f"SELECT parent, code, count(*) AS cnt, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT {_code(3)} AS code, {_code(3)} >> 2 AS parent, n FROM ({WORLD})) GROUP BY ROLLUP (parent, code)",
    "rank_points_in_cell": f"SELECT code, CAST(r AS INTEGER) AS r, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY lon, lat, k, n) AS r FROM (SELECT *, {_code(4)} AS code FROM ({WORLD}))) WHERE r <= 3",
    "spatial_join_within": f"SELECT id, count(*) AS cnt FROM ({CITY}) JOIN ({RECTS}) ON lon > x0 AND lon < x0 + w AND lat > y0 AND lat < y0 + h GROUP BY id",
    "cells_intersect": f"SELECT {_code(12)} AS code FROM ({CITY}) INTERSECT SELECT {_code(12, 'x0', 'y0')} AS code FROM ({RECTS})",
    "cells_except": f"SELECT {_code(12)} AS code FROM ({CITY}) EXCEPT SELECT {_code(12, 'x0', 'y0')} AS code FROM ({RECTS})",
    **{f"spatial_{x}_join": f"SELECT count(*) AS cnt, CAST(sum(k) AS BIGINT) AS keys FROM ({CITY}) p WHERE {no} EXISTS (SELECT 1 FROM ({RECTS}) WHERE lon > x0 AND lon < x0 + w AND lat > y0 AND lat < y0 + h)" for x, no in (("semi", ""), ("anti", "NOT"))},
    "reindex_new_rows": f"""SELECT (SELECT count(*) FROM lineitem) + 6 * s AS all_rows, 4 * s AS no_cell, 2 * s AS beyond, c AS cnt, c AS found
        FROM (SELECT count(*) AS s FROM supplier), (SELECT count(*) AS c FROM ({CITY}) WHERE NOT ({_BOXED}))""",
    "cells_geojson_export": f"SELECT CAST(rank() OVER (PARTITION BY i ORDER BY xmin, ymin) - 1 AS BIGINT) AS polygon, CAST(1 + i AS BIGINT) AS corner, CASE WHEN i IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN i IN (2, 3) THEN ymax ELSE ymin END AS y FROM ({CELLS}), range(5) t(i)",
    "contains_general": f"SELECT id, {_TRIANGLE.format(u='u', v='v')} AS inside, {_TRIANGLE.format(u='(u / 2)', v='(v / 2)')} AND {_TRIANGLE.format(u='u', v='v')} AS line_inside FROM (SELECT id, (id % 10 + 1) / 15.5::DOUBLE AS u, (id % 7 + 1) / 15.5::DOUBLE AS v FROM ({RECTS}))",
    "quad_grown_counts": _ADAPTIVE + "SELECT code, count(*) AS cnt FROM own GROUP BY code",
    "drop_index": "SELECT count(*) AS cnt, CAST(0 AS BIGINT) AS coded, CAST(0 AS BIGINT) AS cells FROM lineitem",
    "sql_point_functions": f"SELECT CAST(CASE WHEN b & 4294967295 >= 2147483648 THEN (b & 4294967295) - 4294967296 ELSE b & 4294967295 END AS INTEGER) AS num, code, round(lon, 6) AS x, 1 AS n, count(*) AS cnt FROM (SELECT lon, {_code(4)} AS code, {_geohash_sql()} AS b FROM ({WORLD})) GROUP BY ALL",
    "sql_geohash_group": f"SELECT {_text_sql('b')} AS geohash, cnt FROM (SELECT {_geohash_sql()} AS b, count(*) AS cnt FROM ({CITY}) GROUP BY 1)",
    "sql_line_functions": _TRACK + "SELECT k, CASE WHEN count(*) >= 2 THEN round(sum(CASE WHEN px IS NULL THEN 0 ELSE sqrt((lon - px) ** 2 + (lat - py) ** 2) END), 9) END AS length, max(lon) AS x, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY k",
    "sql_polygon_functions": f"SELECT id, round(w * h * 3 / 4, 12) AS area, round(x0 + w / 2, 7) AS x, true AS edge, false AS hole FROM ({RECTS})",
    "sql_wkb_roundtrip": f"SELECT CAST(sum(c) AS BIGINT) AS points, round(sum(x), 6) AS x FROM (SELECT count(*) AS c, min(lon) AS x FROM ({CITY}) GROUP BY k)",
}

QUERIES = {
    f.__name__: f
    for f in (
        xy_points_fsp, quad_code_depth4, quad_parent_rollup, quad_box_codes, quad_adaptive_counts, window_count_outside, window_count_outside_indexed, window_count_inside, window_count_inside_indexed,
        trajectory_line_filter, trajectory_length, bbox_diagonal_avg, box_contains_area, area_spheroid_rect, holed_area, bbox_in_box_count, vertex_count_sum, geohash8_group, geohash_numeric, geohash_sorted_topk,
        region_histogram, spatial_join_points_cells, spatial_join_within, spatial_semi_join, spatial_anti_join, union_start_end, geojson_props_infer, ndjson_convert, reindex_new_rows, rebuild_index,
        parts_offsets_polygon, sp_roundtrip, centroid, polygon_centroid, start_end_point, wkt_roundtrip, cells_geojson_export, contains_general, cell_rollup, rank_points_in_cell, cells_intersect, cells_except,
        quad_grown_counts, drop_index, sql_point_functions, sql_geohash_group, sql_line_functions, sql_polygon_functions, sql_wkb_roundtrip,
    )
}
QUERIES |= {f"decode_sum_diff_{x}": _decode_sum(x) for x in CODECS}
QUERIES |= {f"window_sum_indexed_{x}": _window_layout(x) for x in CODECS}

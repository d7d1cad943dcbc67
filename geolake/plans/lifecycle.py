"""Registered queries over sources, a table's life, streams and the remaining geometry functions, with the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geolake.functions import geohash as H
from geolake.functions import geometry as G
from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS, collection_members, encode_rows
from geolake.plans import queries as P
from geolake.plans.api import GeoLake
from geolake.plans.table import GeoTable, TableSpec, create_table
from geolake.sources.convert import convert_collections
from geolake.sources.inspect import parquet_stats
from geolake.sources.readers import points_from_xy, read_geojson, read_spatial

#: The rows that overwritten_cells writes.
FRESH = "(n = 7 AND k % 32 < 8)"
ALL = {"driver_rows": 10_000_000, "max_rows": P.TREE_ROWS}


def _folder(spark, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/geolake_queries/{name}_{uuid.uuid4().hex}"


def _table(spark, name: str) -> GeoTable:
    return GeoTable(spark, TableSpec("geolake_queries", f"{name}_{uuid.uuid4().hex}", spark.conf.get("spark.sql.warehouse.dir")), "fsp")


def _parts(spark, sf_dir):
    return P.view(spark, sf_dir, P.RECTS)


def distance_general(spark, sf_dir):
    """From each rectangle to a point and to a smaller rectangle, which lie within, on the edge of or beyond it."""
    r = _parts(spark, sf_dir)
    x0, y0, w, h, i = (F.col(c) for c in ("x0", "y0", "w", "h", "id"))
    x, y = x0 + w * (i % 5 - 2), y0 + h * (i % 7 - 3)
    box = G.st_polygon_from_envelope(x0, y0, x0 + w, y0 + h)
    return r.select("id", F.round(G.st_distance(box, G.st_point(x, y)), 9).alias("point"), F.round(G.st_distance(G.st_polygon_from_envelope(x, y, x + w / 4, y + h / 4), box), 9).alias("polygon"))


def geojson_types(spark, sf_dir):
    """Features of all simple types, with a property of another type in some; lines that are no feature are left out."""
    r = _parts(spark, sf_dir)
    i, x, y = F.col("id"), F.col("x0"), F.col("y0")
    p = lambda a, b: F.array(x + a, y + b)
    ring = F.array(p(0, 0), p(2, 0), p(2, 1), p(0, 0))
    shapes = [("Point", p(0, 0)), ("LineString", F.array(p(0, 0), p(1, 1))), ("Polygon", F.array(ring)), ("MultiPoint", F.array(p(0, 0), p(1, 0), p(2, 0))), ("MultiLineString", F.array(F.array(p(0, 0), p(1, 1)), F.array(p(2, 2), p(3, 3), p(4, 4)))), ("MultiPolygon", F.array(F.array(ring), F.array(ring)))]
    text = None
    for k, (name, at) in enumerate(shapes):
        one = F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{name}","coordinates":'), F.to_json(at), F.lit('},"properties":{"v":'), F.when(i % 10 == 3, F.lit('"text"')).otherwise(i.cast("string")), F.lit("}}"))
        text = F.when(i % 6 == k, one) if text is None else text.when(i % 6 == k, one)
    bad = F.when(i % 2 == 0, "no feature").otherwise('{"type":"Feature","geometry":null,"properties":{}}')
    path = _folder(spark, "features") + ".geojson"
    r.select(F.explode(F.array(text, bad)).alias("value")).write.text(path)
    f = read_geojson(spark, path, properties={"v": "bigint"})
    g = F.col("geometry")
    return f.groupBy(g["type"].alias("type")).agg(F.count("*").alias("cnt"), F.count("v").alias("numbers"), F.sum(G.num_points(g)).alias("points"), F.sum(G.st_num_geometries(g)).alias("members"))


def csv_points(spark, sf_dir):
    """Coordinates through a CSV file into points, without any other column."""
    path = _folder(spark, "points") + ".csv"
    P.view(spark, sf_dir, P.CITY).select("k", F.when(F.col("n") != 7, F.col("lon")).alias("lon"), "lat").write.option("header", True).csv(path)
    g = points_from_xy(read_spatial(spark, path), "lon", "lat", CODECS["fsp"])
    return g.agg(F.count("*").alias("cnt"), F.round(F.sum(G.st_x("geometry")), 4).alias("xs"), F.round(F.sum(G.st_y("geometry")), 4).alias("ys"))


def footer_bounds(spark, sf_dir):
    """Rows and bounds of a table's columns from its Parquet footers."""
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").inputFiles()
    s = parquet_stats(spark, files).where(F.col("column").isin("l_orderkey", "l_partkey", "l_linenumber"))
    return s.groupBy("column").agg(F.sum("rows").alias("cnt"), F.min(F.col("min").cast("long")).alias("low"), F.max(F.col("max").cast("long")).alias("high"))


def snapshot_counts(spark, sf_dir):
    """Rows of every snapshot of a table that was appended to, indexed, appended to again and compacted."""
    t = _table(spark, "snapshots")
    p = P._points(spark, sf_dir, P.CITY)
    t.append(p.where("n <= 2"))
    t.add_index_to_new_rows(**ALL)
    t.append_indexed(p.where("n > 2"), **ALL)
    t.compact()
    rows = None
    for s in t.snapshots().orderBy("snapshot").collect():
        one = t.df(s.snapshot).agg(F.lit(s.operation).alias("operation"), F.count("*").alias("cnt"), F.count("region_code").alias("coded"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def expired_files(spark, sf_dir):
    """What is left after all snapshots but the last have been expired: files, their rows and their cells from the manifests."""
    t = P._index_table(spark, sf_dir, "expire")
    t.rebuild_index(**ALL)
    t.expire_snapshots(1)
    t = GeoTable(spark, t.spec)
    one = t.snapshots().agg(F.count("*").alias("snapshots"))
    return t.files().groupBy(F.col("region_code").alias("code")).agg(F.sum("rows").alias("cnt")).crossJoin(F.broadcast(one))


def overwritten_cells(spark, sf_dir):
    """Every cell that holds one of the fresh rows (some orders' seventh lines) is replaced by those; all others stay."""
    t = P._index_table(spark, sf_dir, "overwrite")
    t.rebuild_index(**ALL)
    t.overwrite_cells(P._points(spark, sf_dir, P.CITY).where(FRESH))
    return t.df().groupBy(F.col("region_code").alias("code")).agg(F.count("*").alias("cnt"), F.sum("n").alias("lines"))


def saved_tree(spark, sf_dir):
    """The tree's cells, written and read again, hold every row of the table."""
    t = P.city_table(spark, sf_dir)
    path = _folder(spark, "cells")
    t.save_cells(path)
    cells = spark.read.parquet(path)
    held = t.partitions().select(F.col("region_code").alias("code"), "count")
    return cells.join(held, "code", "left").groupBy(F.col("code").isNotNull().alias("known")).agg(F.sum(F.coalesce(held["count"], F.lit(0))).alias("cnt"))


def sampled_tree(spark, sf_dir):
    """A tree grown from a sample of a tenth of the rows has a cell for every row."""
    t = _table(spark, "sampled")
    p = P._points(spark, sf_dir, P.CITY)
    t.append_indexed(p, driver_rows=max(1, p.count() // 10), max_rows=P.TREE_ROWS, mode="sampled")
    return t.df().agg(F.count("*").alias("cnt"), F.count("region_code").alias("coded"))


def collections_batch(spark, sf_dir):
    """A feature collection for each region as a file of its own, all converted at once."""
    c = P.view(spark, sf_dir, P.CELLS)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("xmin", "ymin").alias("coordinates")).alias("geometry"), F.struct("cid", "name").alias("properties"))
    one = c.groupBy((F.col("cid") % 5).alias("region")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    source, out = _folder(spark, "collections"), _folder(spark, "lines") + ".ndjson"
    one.write.partitionBy("region").text(source)
    convert_collections(spark, f"{source}/region=*", out)
    f = read_geojson(spark, out)
    return f.groupBy(G.st_x("geometry").alias("x")).agg(F.count("*").alias("cnt"), F.sum("cid").alias("ids"))


def null_bounds(spark, sf_dir):
    """Bounds in every layout of lines without points, null geometries and real ones."""
    odd = P._odd_rows(spark, sf_dir).select("n", "geometry")
    out = None
    for name, codec in CODECS.items():
        b = codec.bbox(codec.encode("geometry"))
        one = encode_rows(odd.withColumn("shape", F.col("geometry")), codec).select("n", F.lit(name).alias("layout"), codec.bbox(F.col("geometry")).alias("b")) if name == "wkb" else odd.select("n", F.lit(name).alias("layout"), b.alias("b"))
        one = one.select("layout", F.abs("n").alias("kind"), F.col("b.min_x").alias("x"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("layout").agg(F.count_if(F.col("x").isNotNull()).alias("bounded"), F.max("x").alias("x"))


def centroid_geohash(spark, sf_dir):
    """Cells of six geohash characters that the centroids of triangles fall into."""
    r = _parts(spark, sf_dir)
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    tri = G.flat_struct(F.lit(3), F.array(x0, x0 + w, x0, x0), F.array(y0, y0, y0 + h, y0), F.array(F.lit(0)))
    return r.select("id", tri.alias("geometry")).select("id", H.geometry_geohash("geometry", "centroid", 6).alias("geohash"))


def vertex_exists(spark, sf_dir):
    """Tracks with a vertex in the box, over nested parts; and their second vertices."""
    sp = CODECS["sp"].encode(G.line_from_multipoint("geometry"))
    x, y = (lambda c: c["x"]), (lambda c: c["y"])
    inside = F.exists(sp["parts"], lambda part: F.exists(part["coordinates"], lambda c: x(c).between(P.BOX[0], P.BOX[2]) & y(c).between(P.BOX[1], P.BOX[3])))
    second = G.st_point_n(G.line_from_multipoint("geometry"), 2)
    return P._tracks(spark, sf_dir).where(G.num_points("geometry") >= 2).where(inside).select("k", G.st_x(second).alias("x"), G.st_y(second).alias("y"))


def geojson_text(spark, sf_dir):
    """Polygons with holes as GeoJSON text, parsed again: rings, and corners of the hole."""
    shape = F.from_json(G.st_as_geojson("geometry"), "type string, coordinates array<array<array<double>>>")
    r = P._holed(spark, sf_dir).select("id", shape.alias("s"))
    return r.select("id", F.col("s.type").alias("type"), F.size("s.coordinates").alias("rings"), F.round(F.array_min(F.transform(F.get("s.coordinates", F.lit(1)), lambda c: F.get(c, F.lit(0)))), 9).alias("x"))


def collections_nested(spark, sf_dir):
    """Collections of a point, a rectangle and a collection of a line: members in order, whatever the nesting."""
    r = _parts(spark, sf_dir)
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    pair = lambda a, b: F.to_json(F.array(a, b))
    ring = F.concat(F.lit("[["), pair(x, y), F.lit(","), pair(x + w, y), F.lit(","), pair(x + w, y + h), F.lit(","), pair(x, y + h), F.lit(","), pair(x, y), F.lit("]]"))
    value = F.concat(F.lit('{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), pair(x, y), F.lit('},{"type":"Polygon","coordinates":'), ring, F.lit('},{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":['), pair(x, y), F.lit(","), pair(x + 3, y + 4), F.lit(']}]}]},"properties":{"id":'), F.col("id").cast("string"), F.lit("}}"))
    path = _folder(spark, "nested") + ".geojson"
    r.select(value.alias("value")).write.text(path)
    f = read_geojson(spark, path, nested=True, properties={"id": "bigint"}).select("id", collection_members("geometry").alias("m"))
    member = f.select("id", F.posexplode("m").alias("place", "g"))
    return member.groupBy("place", F.col("g.type").alias("type")).agg(F.count("*").alias("cnt"), F.round(F.sum(G.st_area("g")), 6).alias("area"), F.round(F.sum(G.st_length("g")), 6).alias("length"))


def facade_tables(spark, sf_dir):
    """Rectangles as WKT through the facade into each layout: some indexed at once, some later, the index rebuilt, a box queried."""
    r = P._rects(spark, sf_dir).select("id", G.st_as_text("geometry").alias("Geometry"))
    out = None
    for layout in CODECS:
        lake = GeoLake(spark, input_format="wkt", geometry_format=layout)
        name = f"facade_{layout}_{uuid.uuid4().hex}"
        lake.write_with_index("geolake_queries", name, r.where("id % 2 = 0"), 10_000_000, P.TREE_ROWS)
        lake.write("geolake_queries", name, r.where("id % 2 = 1"))
        lake.add_index_to_new_rows("geolake_queries", name, 10_000_000, P.TREE_ROWS)
        lake.rebuild_index("geolake_queries", name, 10_000_000, P.TREE_ROWS)
        t = lake.table("geolake_queries", name)
        b = lake.codec.bbox(F.col("geometry"))
        near = t.window(*P.BOX).select("id", b.alias("b")).where(f"b.min_x >= {P.BOX[0]} AND b.max_x <= {P.BOX[2]} AND b.min_y >= {P.BOX[1]} AND b.max_y <= {P.BOX[3]}")
        one = near.agg(F.lit(layout).alias("layout"), F.count("*").alias("cnt"), F.sum("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def streamed_points(spark, sf_dir):
    """A stream of coordinates into an indexed table, one snapshot for each micro-batch."""
    from geolake.streaming.ingest import stream_points

    source = _folder(spark, "stream")
    P.view(spark, sf_dir, P.WORLD).select("lon", "lat").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("lon double, lat double").option("maxFilesPerTrigger", 2).parquet(source)
    lake, name = GeoLake(spark), f"stream_{uuid.uuid4().hex}"
    stream_points(lake, stream, "geolake_queries", name, "lon", "lat", _folder(spark, "checkpoint")).awaitTermination()
    t = lake.table("geolake_queries", name)
    return t.df().groupBy(Q.point_code(F.col("geometry.x")[0], F.col("geometry.y")[0], 4).alias("code")).agg(F.count("*").alias("cnt"))


def catalog_partitions(spark, sf_dir):
    """A partitioned catalog table made from a schema, filled and counted by partition."""
    name = f"geolake_catalog_{uuid.uuid4().hex}"
    rows = P.view(spark, sf_dir, P.WORLD).select("k", "lon", Q.point_code("lon", "lat", 2).alias("code"))
    create_table(spark, name, rows.schema, partition_by=["code"])
    rows.write.insertInto(name)
    return spark.table(name).groupBy("code").agg(F.count("*").alias("cnt"))


_APART = "sqrt(greatest(x0 - {x}, {u} - x0 - w, 0) ** 2 + greatest(y0 - {y}, {v} - y0 - h, 0) ** 2)"
_X, _Y = "(x0 + w * (id % 5 - 2))", "(y0 + h * (id % 7 - 3))"
ORACLE_SQL = {
    "distance_general": f"SELECT id, round({_APART.format(x=_X, u=_X, y=_Y, v=_Y)}, 9) AS point, round({_APART.format(x=f'({_X} + w / 4)', u=_X, y=f'({_Y} + h / 4)', v=_Y)}, 9) AS polygon FROM ({P.RECTS})",
    "geojson_types": "SELECT CAST(list_extract([1, 2, 3, 4, 5, 6], CAST(p_partkey % 6 + 1 AS INTEGER)) AS INTEGER) AS type, count(*) AS cnt, count(*) FILTER (p_partkey % 10 <> 3) AS numbers, CAST(sum(list_extract([1, 2, 4, 3, 5, 8], CAST(p_partkey % 6 + 1 AS INTEGER))) AS BIGINT) AS points, CAST(sum(list_extract([1, 1, 1, 3, 2, 2], CAST(p_partkey % 6 + 1 AS INTEGER))) AS BIGINT) AS members FROM part GROUP BY 1",
    "csv_points": f"SELECT count(*) AS cnt, round(sum(lon), 4) AS xs, round(sum(lat), 4) AS ys FROM ({P.CITY}) WHERE n <> 7",
    "footer_bounds": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS cnt, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_linenumber")),
    "snapshot_counts": """WITH c AS (SELECT count(*) AS a, count(*) FILTER (l_linenumber <= 2) AS f FROM lineitem)
        SELECT 'append' AS operation, f AS cnt, CAST(0 AS BIGINT) AS coded FROM c UNION ALL SELECT 'add_index', f, f FROM c UNION ALL SELECT 'append_indexed', a, a FROM c UNION ALL SELECT 'compact', a, a FROM c""",
    "expired_files": P._ADAPTIVE + "SELECT code, count(*) AS cnt, CAST(1 AS BIGINT) AS snapshots FROM own GROUP BY code",
    "overwritten_cells": P._ADAPTIVE + f", named AS (SELECT own.code, p.n, {FRESH} AS fresh FROM own JOIN p USING (r)), met AS (SELECT DISTINCT code FROM named WHERE fresh) SELECT code, count(*) AS cnt, CAST(sum(n) AS BIGINT) AS lines FROM named WHERE fresh OR code NOT IN (SELECT code FROM met) GROUP BY code",
    "saved_tree": "SELECT true AS known, count(*) AS cnt FROM lineitem",
    "sampled_tree": "SELECT count(*) AS cnt, count(*) AS coded FROM lineitem",
    "collections_batch": f"SELECT xmin AS x, count(*) AS cnt, CAST(sum(cid) AS BIGINT) AS ids FROM ({P.CELLS}) GROUP BY xmin",
    "null_bounds": "SELECT unnest(['wkb', 'sp', 'fsp', 'nfsp']) AS layout, count(*) AS bounded, CAST(300 AS DOUBLE) AS x FROM supplier",
    "centroid_geohash": f"SELECT id, {P._text_sql('b', 6)} AS geohash FROM (SELECT id, {P._geohash_sql(6)} AS b FROM (SELECT id, x0 + w / 3 AS lon, y0 + h / 3 AS lat FROM ({P.RECTS})))",
    "vertex_exists": f"SELECT k, list_extract(xs, 2) AS x, list_extract(ys, 2) AS y FROM (SELECT k, list(lon ORDER BY n, lon, lat) AS xs, list(lat ORDER BY n, lon, lat) AS ys, bool_or(NOT ({P._BOXED})) AS inside FROM ({P.CITY}) GROUP BY k) WHERE inside AND len(xs) >= 2",
    "geojson_text": f"SELECT id, 'Polygon' AS type, 2 AS rings, round(x0 + w / 4, 9) AS x FROM ({P.RECTS})",
    "collections_nested": f"SELECT 0 AS place, 1 AS type, count(*) AS cnt, 0.0::DOUBLE AS area, 0.0::DOUBLE AS length FROM part UNION ALL SELECT 1, 3, count(*), round(sum(w * h), 6), 0.0 FROM ({P.RECTS}) UNION ALL SELECT 2, 2, count(*), 0.0, CAST(5 * count(*) AS DOUBLE) FROM part",
    "facade_tables": f"SELECT unnest(['wkb', 'sp', 'fsp', 'nfsp']) AS layout, count(*) AS cnt, CAST(sum(id) AS BIGINT) AS ids FROM ({P.RECTS}) WHERE {P._RECT_BOX}",
    "streamed_points": f"SELECT {P._code(4)} AS code, count(*) AS cnt FROM ({P.WORLD}) GROUP BY 1",
    "catalog_partitions": f"SELECT {P._code(2)} AS code, count(*) AS cnt FROM ({P.WORLD}) GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (distance_general, geojson_types, csv_points, footer_bounds, snapshot_counts, expired_files, overwritten_cells, saved_tree, sampled_tree, collections_batch, null_bounds, centroid_geohash, vertex_exists, geojson_text, collections_nested, facade_tables, streamed_points, catalog_partitions)}

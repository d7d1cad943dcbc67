import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from geolake.functions import geometry as G
from geolake.operators.joins import spatial_join
from geolake.plans.api import GeoLake
from geolake.plans.table import SchemaMismatch, create_table
from geolake.sources import convert, inspect
from geolake.sources.readers import infer_properties, read_geojson, read_spatial
from geolake.streaming.ingest import stream_points, windowed_cell_counts

LINES = [
    '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":1,"b":1.5,"c":true,"d":{"z":1},"e":7,"f":null}}',
    '{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4]},"properties":{"a":1.5,"b":2.0,"c":false,"d":{"z":2},"e":8,"f":null}}',
    '{"type":"Feature","geometry":null,"properties":{"a":2}}',
    '{"type":"Feature","geometry":{"type":"Point","coordinates":[5,6]},"properties":null}',
    '{"type":"Point","coordinates":[0,0]}',
    "{not json",
]


def test_inference():
    assert infer_properties(LINES) == {"a": "string", "b": "double", "c": "boolean", "d": "string", "e": "bigint"}


def test_read_geojson(spark, tmp_path):
    (tmp_path / "f.geojson").write_text("\n".join(LINES))
    seen = Observation()
    df = read_geojson(spark, str(tmp_path / "f.geojson"), observation=seen)
    assert df.dtypes[1:] == [("a", "string"), ("b", "double"), ("c", "boolean"), ("d", "string"), ("e", "bigint")]
    rows = df.collect()
    assert [(r.geometry["x"], r.a, r.b, r.c, r.d, r.e) for r in rows] == [([1], "1", 1.5, True, '{"z":1}', 7), ([3], "1.5", 2.0, False, '{"z":2}', 8), ([5], None, None, None, None, None)]
    assert seen.get["bad_rows"] == 3


def test_every_geojson_type(spark, tmp_path):
    shapes = [
        ("Point", [1, 2], 1, []), ("LineString", [[0, 0], [1, 1]], 2, []), ("MultiPoint", [[0, 0], [1, 1]], 4, []),
        ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], 3, [0, -4]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], 5, [0, 2]),
        ("MultiPolygon", [[[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], [[[9, 9], [10, 9], [10, 10], [9, 9]]]], 6, [0, -4, 8]),
    ]
    lines = [json.dumps({"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": {"n": k}}) for k, (t, c, _, _) in enumerate(shapes)]
    lines.append(json.dumps({"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}, "properties": {"n": 6}}))
    (tmp_path / "all.ndjson").write_text("\n".join(lines))
    rows = read_spatial(spark, str(tmp_path / "all.ndjson")).orderBy("n").collect()
    assert [(r.geometry["type"], r.geometry["parts"]) for r in rows] == [(k, p) for _, _, k, p in shapes]
    nested = read_geojson(spark, str(tmp_path / "all.ndjson"), nested=True).orderBy("n").collect()
    assert len(nested) == 7 and nested[6].geometry["geometries"] == [0, 1, 7] and nested[5].geometry["parts"] == [0, -4, 8, 11]
    assert [json.loads(r.g)["coordinates"] for r in read_spatial(spark, str(tmp_path / "all.ndjson")).orderBy("n").select(G.st_as_geojson("geometry").alias("g")).collect()] == [c for _, c, _, _ in shapes]


def test_collections_to_lines(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, k]}, "properties": p} if p != 0 else {"type": "Feature", "geometry": None} for k, p in enumerate([{"a": 1}, None, 0])]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "x": [1], "features": features, "later": {"features": [1]}}))
    got = [json.loads(r.value) for r in convert.feature_lines(spark, str(tmp_path / "c.json")).collect()]
    assert sorted(json.dumps(g["properties"]) for g in got) == ['{"a": 1}', "{}", "{}"]
    for chunk in (7, 1 << 20):
        assert [json.loads(x)["properties"] for x in convert.stream_features(str(tmp_path / "c.json"), chunk)] == [{"a": 1}, {}, {}]
    assert convert.convert_stream(str(tmp_path / "c.json"), str(tmp_path / "o.ndjson")) == 3
    convert.convert_collections(spark, str(tmp_path / "c.json"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def points(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7919 % 2003 / 100).alias("x"), (F.col("id") * 104729 % 997 / 100).alias("y"))


@pytest.mark.parametrize("layout", ["wkb", "nfsp"])
def test_life_of_a_table(spark, tmp_path, layout):
    lake = GeoLake(spark, "wkt", layout, str(tmp_path))
    p = points(spark)
    t = lake.write_with_index("db", "t", p, 10_000, 150, x="x", y="y", keep_columns=True)
    lake.write("db", "t", p.withColumn("k", F.col("k") + 10_000), x="x", y="y", keep_columns=True)
    box = (2.0, 1.0, 9.0, 6.0)
    inside = (F.col("x") >= box[0]) & (F.col("x") <= box[2]) & (F.col("y") >= box[1]) & (F.col("y") <= box[3])
    want = 2 * p.where(inside).count()
    for step in (None, t.add_index_to_new_rows, t.compact, t.rebuild_index, lambda: t.cluster(F.col("k"))):
        if step:
            step()
        t = lake.table("db", "t")
        assert t.df().count() == 4000 and t.window(*box).where(inside).count() == want
        assert t.window(*box, outside=True).where(~inside).count() == 4000 - want
    assert t.df().where("region_code is null").count() == 0 and t.add_index_to_new_rows() is False
    assert t.decoded().where((G.st_x("geom") != F.col("x")) | (G.st_y("geom") != F.col("y"))).count() == 0
    cell = F.col("geometry.bbox_partitioning")
    assert t.df().where((cell["min_x"] > F.col("x")) | (cell["max_x"] < F.col("x")) | (cell["min_y"] > F.col("y")) | (cell["max_y"] < F.col("y")) | (cell["region_code"] != F.col("region_code"))).count() == 0
    assert [r.operation for r in t.snapshots().orderBy("snapshot").collect()] == ["append_indexed", "append", "add_index", "compact", "rebuild_index", "cluster"]
    assert t.df(1).count() == 2000 and t.partitions().agg(F.sum("count")).first()[0] == 4000 and t.files().count() > 0
    assert t.expire_snapshots() > 0 and t.df().count() == 4000 and t.delete_orphans() == 0
    with pytest.raises(SchemaMismatch):
        lake.write("db", "t", p, x="x", y="y")


def test_scan_reads_only_what_it_needs(spark, tmp_path):
    lake = GeoLake(spark, "wkb", "fsp", str(tmp_path))
    t = lake.write_with_index("db", "p", points(spark), 10_000, 150, x="x", y="y")
    plan = t.window(1.0, 1.0, 2.0, 2.0).select(F.col("geometry.x")[0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "region_code" in plan and "struct<x:array<double>>" in plan


def test_files_and_wkt_input(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Geometry,name\n"POINT(1 2)",a\n"POINT(300 2)",b\nbad,c\n"LINESTRING(0 0,50 50)",d\n')
    lake = GeoLake(spark, "wkt", "fsp", str(tmp_path / "w"))
    t = lake.write_with_index("db", "csv", str(tmp_path / "in.csv"))
    rows = {r.name: r for r in t.df().collect()}
    assert set(rows) == {"a", "b", "d"} and rows["b"].region_code == 1 and rows["b"].geometry["bbox_partitioning"]["max_x"] == 300
    assert {r.name for r in t.window(250.0, 0.0, 350.0, 5.0).collect()} >= {"b"}
    with pytest.raises(ValueError):
        read_spatial(spark, "x.txt")
    with pytest.raises(ValueError):
        GeoLake(spark, "gml")
    files = [r.file for r in t.files().collect()]
    assert inspect.parquet_stats(spark, files).where("column like '%region_code%' or column = 'name'").count() > 0 and "name" in inspect.parquet_schema(files[0])
    create_table(spark, "geolake_test", t.df().schema, partition_by=["region_code"])
    assert spark.table("geolake_test").columns[-1] == "region_code"
    spark.sql("DROP TABLE geolake_test")


def test_spatial_join_paths(spark, monkeypatch):
    p = points(spark, 800).select("k", G.st_point("x", "y").alias("g"))
    r = spark.range(40).select(F.col("id").alias("c"), G.st_polygon_from_envelope(F.col("id") * 0.9 - 1, F.lit(1.0), F.col("id") * 0.9 + 0.55, F.lit(8.0)).alias("g"))
    small = sorted((x.k, x.c) for x in spatial_join(p, r, "g", "g").select("k", "c").collect())
    monkeypatch.setattr("geolake.operators.joins.SMALL", 0)
    large = sorted((x.k, x.c) for x in spatial_join(p, r, "g", "g", step=7.0).select("k", "c").collect())
    want = sorted((q.k, c) for q in points(spark, 800).collect() for c in range(40) if c * 0.9 - 1 < q.x < c * 0.9 + 0.55 and 1 < q.y < 8)
    assert small == large == want
    keys = {k for k, _ in want}
    assert {x.k for x in spatial_join(p, r, "g", "g", how="left_semi", step=7.0).collect()} == keys
    assert {x.k for x in spatial_join(p, r, "g", "g", how="left_anti", step=7.0).collect()} == {q for q in range(800)} - keys


def test_streams(spark, tmp_path):
    points(spark, 300).withColumn("t", F.timestamp_seconds(F.col("k") * 10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, x double, y double, t timestamp").parquet(str(tmp_path / "in"))
    lake = GeoLake(spark, "wkb", "fsp", str(tmp_path / "w"))
    stream_points(lake, stream, "db", "s", "x", "y", str(tmp_path / "c")).awaitTermination()
    assert lake.table("db", "s").df().count() == 300
    q = windowed_cell_counts(stream, "t", "x", "y").writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("cells").agg(F.sum("count")).first()[0] == 300


def test_executors_need_no_installation(tmp_path):
    """Python functions run where the package is not on the path."""
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from geolake.functions import geometry as G\n"
        "from geolake.plans.session import make_local_session\n"
        "spark = make_local_session(cores=1, driver_memory='1g')\n"
        "print('bytes', spark.range(1).select(G.st_point('id', 'id').alias('g')).select(G.st_as_wkb('g').alias('w')).first().w.hex())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "bytes 0101000000" in out.stdout, out.stderr[-2000:]

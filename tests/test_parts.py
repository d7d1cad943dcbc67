"""Data files follow the rows and not the cells; cells are found in them, and in folders partitioned by cell."""

import uuid

from pyspark.sql import functions as F

from geolake.functions import geometry as G
from geolake.operators.quadtree import Quadtree
from geolake.plans import table as P
from geolake.plans.table import CODE, GeoTable, TableSpec


def points(spark, start, n):
    return spark.range(start, start + n).select(F.col("id").alias("k"), G.st_point(F.col("id") * 7919 % 2003 / 100, F.col("id") * 104729 % 997 / 100).alias("geometry"))


def test_parts_hold_whole_cells_up_to_a_number_of_rows():
    tree = Quadtree.initial()
    tree.split |= {256, 1024, 1025}
    tree.counts = {4096: 30.0, 4097: 40.0, 4100: 50.0, 257: 10.0, 300: 5.0}
    parts = dict(tree.parts(100))
    assert set(parts) == set(tree.nodes()) and (parts[4096], parts[4097], parts[4100], parts[4103]) == (1024, 1024, 1025, 1025)
    assert parts[256] == 256 and parts[1026] == 1026 and parts[257] == 257 and set(dict(tree.parts(1000)).values()) == {1}
    assert all(c >> 2 * ((c.bit_length() - p.bit_length()) // 2) == p for c, p in parts.items())


def test_files_follow_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "PART_ROWS", 500)
    t = GeoTable(spark, TableSpec("db", "t", str(tmp_path)))
    t.append_indexed(points(spark, 0, 2000), 10_000, 20)
    cells = t.partitions().count()
    assert cells > 100 and t.files().select("file").distinct().count() <= cells / 4
    held = {r[CODE]: r["count"] for r in t.partitions().collect()}
    assert held == {r[CODE]: r["count"] for r in t.df().groupBy(CODE).count().collect()}
    code = max(held, key=held.get)
    assert t._rows_of(t.snapshot(), t.snapshot()["folders"], [code]).count() == held[code]


def test_folders_by_cell_are_read_on(spark, tmp_path):
    """A table written with a partition for each cell, then appended to."""
    t = GeoTable(spark, TableSpec("db", "t", str(tmp_path)))
    t.append_indexed(points(spark, 0, 600), 10_000, 60)
    body, name = dict(t.snapshot()), f"batch={uuid.uuid4().hex}"
    t.df().write.partitionBy(CODE).parquet(f"{t.path}/data/{name}")
    t.manifest().drop(P.PART).write.parquet(t._manifest_path({"name": name}))
    assert t._publish(body | {"snapshot": 2, "folders": [{"name": name, "indexed": True}]})
    t = GeoTable(spark, t.spec)
    t.append_indexed(points(spark, 600, 600), 10_000, 60)
    whole = GeoTable(spark, TableSpec("db", "whole", str(tmp_path)))
    whole.append_indexed(points(spark, 0, 1200), 10_000, 60)
    assert t.tree().split == whole.tree().split and t.df().count() == 1200
    x, y = (F.get(F.col(f"geometry.{c}"), F.lit(0)) for c in "xy")
    inside = lambda t: sorted(r.k for r in t.window(2.0, 2.0, 9.0, 6.0).where(x.between(2, 9) & y.between(2, 6)).select("k").collect())
    assert inside(t) == inside(whole) != []
    t.compact()
    assert [f.get("parts") for f in t.snapshot()["folders"]] == [True] and inside(t) == inside(whole)


def test_rows_of_deep_trees_take_few_joins(spark, tmp_path):
    """What every indexed write plans: the bisection's joins, that of the parts and that of the bounds."""
    tree = Quadtree.initial()
    tree.split |= {256 << 2 * d for d in range(18)}
    t = GeoTable(spark, TableSpec("db", "t", str(tmp_path)))
    rows = t._indexed(points(spark, 0, 10), tree)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 7 and rows.where(F.col(CODE) >= 256).count() == 10

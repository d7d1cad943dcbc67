"""Trees grow from all boxes, however few rows the driver may hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.functions import geometry as G
from geolake.operators import quadtree as Q
from geolake.plans import queries as P
from geolake.plans.table import GeoTable, TableSpec


@pytest.fixture(scope="module")
def points(spark):
    near = spark.range(4000).selectExpr("id", "13 + (id * 7919 % 997) / 9970 as x", "52 + (id * 104729 % 991) / 9910 as y")
    rows = near.unionByName(spark.range(4000, 4600).selectExpr("id", "id % 360 - 180.0 as x", "id % 180 - 90.0 as y")).unionByName(spark.range(3).selectExpr("id", "200.0 as x", "null as y"))
    return rows.select("id", "x", "y", F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y")).alias("b")).cache()


def test_few_driver_rows_change_nothing(spark, points):
    whole = Q.build_tree(points, F.col("b"), driver_rows=100_000, max_rows=60)
    tree = Q.build_tree(points, F.col("b"), driver_rows=100, max_rows=60)
    assert tree == whole and max(c.bit_length() for c in tree.split) > 17
    assert len(Q.build_tree(points, F.col("b"), driver_rows=100, max_rows=60, mode="sampled").counts) < len(whole.counts)


def test_what_reaches_the_driver(spark, points):
    counted = Q.CountedBoxes(points, F.col("b"))
    tree = Q.Quadtree.initial()
    full = Q.full_cells(counted.rows, 500)
    cut = counted.condensed(tree.split | full)
    assert len(cut.paths) <= 4 * len(tree.split | full) + 1 and len(cut.paths) < 300 < counted.rows.count()
    assert int(np.sum(cut.weight)) == 4600
    counted.release()


def test_tables_grow_alike(spark, points, tmp_path):
    rows = points.where("y is not null").select("id", G.st_point("x", "y").alias("geometry"))
    trees = []
    for driver_rows in (100_000, 50):
        t = GeoTable(spark, TableSpec("db", f"t{driver_rows}", str(tmp_path)))
        for i in range(2):
            t.append_indexed(rows.where(F.col("id") % 2 == i), driver_rows=driver_rows, max_rows=60)
        trees.append((t.tree(), {r.region_code: r["count"] for r in t.partitions().collect()}))
        cells = t.df().where("region_code > 1")
        assert cells.where(F.col("geometry.bbox_partitioning") != Q.cell_struct("region_code")).isEmpty()
    assert trees[0] == trees[1]


def test_region_histogram_of_more_rows_than_the_driver_holds(spark, monkeypatch):
    data, real = "/root/testdata/sf0.001", GeoTable.append_indexed
    want = {tuple(r) for r in P.quad_adaptive_counts(spark, data).collect()}
    monkeypatch.setattr(GeoTable, "append_indexed", lambda self, rows, driver_rows, max_rows: real(self, rows, 1000, max_rows))
    monkeypatch.setattr(P, "_tables", {})
    monkeypatch.setattr(P, "GeoTable", lambda s, spec, layout: GeoTable(s, TableSpec(spec.database, spec.table + "_few", spec.warehouse), layout))
    assert {(r.region_code, r.cnt) for r in P.region_histogram(spark, data).collect()} == want

"""Bounds are worked out once for each row, in code that the JVM compiles."""

import re

from pyspark.sql import functions as F

from geolake.functions import geometry as G
from geolake.operators import quadtree as Q
from geolake.plans.table import GeoTable, TableSpec

NAN = float("nan")


def lines(spark, *xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x array<double>")
    return rows.select("k", G.flat_struct(F.lit(2), F.col("x"), F.col("x"), F.array().cast("array<int>")).alias("geometry"))


def counted(rows):
    return Q.CountedBoxes(rows.select(G.bbox("geometry").alias("__box")), F.col("__box"))


def test_bounds_leave_nan_out(spark):
    b = lines(spark, [3.0, NAN, 1.0], [NAN], [], None, [None, 2.0], [None, NAN, 4.0, 5.0], [float("inf"), 1.0]).select(G.bbox("geometry").alias("b"), "k").orderBy("k")
    found = [(r.b.min_x, r.b.max_x, r.b.min_y, r.b.max_y) for r in b.collect()]
    expected = [(1.0, 3.0), (None, None), (None, None), (None, None), (2.0, 2.0), (4.0, 5.0), (1.0, float("inf"))]
    assert found == [(*e, *e) for e in expected]


def test_boxes_are_counted_from_bounds_worked_out_once(spark):
    c = counted(lines(spark, [1.0, 1.0], [1.0], [89.0, 500.0], [NAN], [], None, [-80.0, 80.0]))
    assert sorted(r.n for r in c.rows.collect()) == [1, 2]  # neither beyond the world nor without bounds; one in the root
    c.release()
    plan = c.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min(" in plan and not [line for line in plan.splitlines() if "Filter" in line and "array_min(" in line]


def test_cells_of_deep_trees_are_compiled(spark, tmp_path):
    tree = Q.Quadtree.initial()
    tree.split |= {256 << 2 * d for d in range(18)}
    rows = GeoTable(spark, TableSpec("db", "t", str(tmp_path)))._indexed(spark.range(10).select("id", G.st_point(F.col("id") / 7, F.col("id") / 9).alias("geometry")), tree)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.PythonSQLUtils.explainString(rows.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000

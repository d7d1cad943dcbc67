"""Rows at one place are joined once, whatever their number."""

import pytest
from pyspark.sql import functions as F

from geolake.functions import geometry as G
from geolake.operators import joins
from geolake.plans import queries as P


@pytest.fixture
def joined(monkeypatch):
    """Rows of both sides of each inner join."""
    sizes, real = [], joins.spatial_join

    def counted(left, right, *args, **kwargs):
        if "inner" in args or not {"left_semi", "left_anti"} & {*args, kwargs.get("how")}:
            sizes.append((left.count(), right.count()))
        return real(left, right, *args, **kwargs)

    monkeypatch.setattr(joins, "spatial_join", counted)
    return sizes


@pytest.fixture
def city(spark, tmp_path):
    """Orders 0, 12000, ... have their lines at one place, three places in all, one of them without coordinates."""
    spark.range(600).selectExpr("if(id % 3 = 2, null, id % 3 + 12000 * (id div 3)) l_orderkey", "1 l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    # the place of order 0: lon -74.1 + 2729 / 10000, lat 40.6 + 843 / 10000
    spark.sql("select * from values (1, 50) t(a, s)").selectExpr("cast(0 as long) p_partkey", "cast(s as int) p_size").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.fixture
def around(monkeypatch):
    """Two rectangles around the place of order 0, with equal bounds."""

    def rects(spark, sf_dir):
        box = G.st_polygon_from_envelope(*[G.F.lit(v) for v in (-73.83, 40.68, -73.82, 40.69)])
        return spark.range(2).select("id", box.alias("geometry"))

    monkeypatch.setattr(P, "_rects", rects)


def keys(part):
    return sum(part + 12000 * i for i in range(200))


def test_anti_join(spark, city, around, joined):
    assert [tuple(r) for r in P.spatial_anti_join(spark, city).collect()] == [(400, keys(1))]
    assert joined == [(3, 1)]


def test_semi_join(spark, city, around, joined):
    assert [tuple(r) for r in P.spatial_semi_join(spark, city).collect()] == [(200, keys(0))]
    assert joined == [(3, 1)]


def test_within(spark, city, around, joined):
    assert sorted(tuple(r) for r in P.spatial_join_within(spark, city).collect()) == [(0, 200), (1, 200)]
    assert joined == [(3, 2)]


@pytest.mark.parametrize("how, n", [("left_semi", 100), ("left_anti", 201)])
def test_operator(spark, joined, how, n):
    at = G.F.when(G.F.col("id") < 300, G.st_point(G.F.when(G.F.col("id") < 100, -0.0).otherwise(5.0), G.F.lit(1.0)))
    left = spark.range(301).select("id", at.alias("geometry"))
    right = spark.range(50).select("id", G.st_polygon_from_envelope(*[G.F.lit(v) for v in (-1.0, 0.0, 2.0, 2.0)]).alias("geometry"))
    assert joins.spatial_join(left, right, "geometry", "geometry", "within", how).count() == n
    assert joined == [(3, 1)]


def test_broadcast_counts_all_cells(spark, monkeypatch):
    """A right side goes to up to four cells of every grid in use; all of these rows would be in the driver."""
    p = spark.range(300).select("id", G.st_point(F.col("id") % 20, F.col("id") % 13).alias("g"))
    r = spark.range(50).select(F.col("id").alias("c"), G.st_polygon_from_envelope(F.col("id") % 7 + 0.5, F.lit(0.5), F.col("id") % 7 + 1.5 + F.col("id") % 5 * 3, F.lit(9.5)).alias("g"))
    monkeypatch.setattr(joins, "SMALL", 50 * (200 + 16 * 5) * 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = joins.spatial_join(p, r, "g", "g")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Broadcast" not in plan


@pytest.mark.parametrize("how, n", [("inner", 1800), ("left_semi", 900), ("left_anti", 100)])
def test_large_sides_are_not_broadcast_by_estimate(spark, monkeypatch, how, n):
    """Spark's estimate of a side does not count the cells its rows go to: below its threshold it would still take all of them to the driver."""
    monkeypatch.setattr(joins, "SMALL", 0)
    p = spark.range(1000).select("id", G.st_point(F.col("id") % 10 + 0.5, F.lit(0.5)).alias("g"))
    r = spark.range(2).select(F.col("id").alias("c"), G.st_polygon_from_envelope(F.lit(-1.0), F.lit(-1.0), F.lit(9.0), F.col("id") + 1.0).alias("g"))
    inner = joins.spatial_join(p, r, "g", "g")
    assert "Broadcast" not in inner._jdf.queryExecution().executedPlan().toString()
    assert joins.spatial_join(p, r, "g", "g", "within", how).count() == n

"""Table maintenance keeps every row, whatever its geometry, and every writer's rows."""

import pytest
from pyspark.sql import functions as F

from geolake import schemas as S
from geolake.functions import geometry as G
from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS
from geolake.plans.table import ConcurrentWrite, GeoTable, SchemaMismatch, TableSpec
from tests.helpers import box_fit


def rows(spark, start=0, n=1000, layout="fsp"):
    """Points, lines, empty lines, points beyond the world, and null geometries."""
    i = F.col("id")
    empty = G.flat_struct(F.lit(S.LINE), F.array().cast("array<double>"), F.array().cast("array<double>"), F.array().cast("array<int>"))
    x, y = (i * 7919 % 2003) / 100, (i * 104729 % 997) / 100
    line = G.flat_struct(F.lit(S.LINE), F.array(x, x + 0.5), F.array(y, y), F.array().cast("array<int>"))
    g = F.when(i % 100 == 1, empty).when(i % 100 == 2, G.st_point(x + 200, y)).when(i % 100 == 3, F.lit(None).cast(S.FSP)).when(i % 7 == 0, line).otherwise(G.st_point(x, y))
    return spark.range(start, start + n).select(i.alias("k"), CODECS[layout].encode(g).alias("geometry"))


def table(spark, path, layout="fsp"):
    return GeoTable(spark, TableSpec("db", "t", str(path)), layout)


def keys(t):
    return sorted(r.k for r in t.df().select("k").collect())


@pytest.mark.parametrize("layout", ["fsp", "wkb"])
def test_every_row_survives_every_operation(spark, tmp_path, layout):
    t = table(spark, tmp_path, layout)
    t.append_indexed(rows(spark, 0, 600, layout), 10_000, 100, stage=layout == "wkb")
    t.append(rows(spark, 1000, 300, layout))
    want = [*range(600), *range(1000, 1300)]
    for step in (lambda: None, lambda: t.add_index_to_new_rows(10_000, 100), t.compact, lambda: t.rebuild_index(10_000, 100), lambda: t.cluster(F.col("k")), t.drop_index, lambda: t.add_index_to_new_rows(10_000, 100), lambda: t.add_index_to_new_rows(10_000, 100)):
        step()
        assert keys(t) == want
        assert t.partitions().agg(F.sum("count")).first()[0] == 900 == t.files().agg(F.sum("rows")).first()[0]
        assert t.window(1.0, 1.0, 9.0, 6.0).where("k % 100 in (1, 3)").count() == 18  # rows without bounds may always match
    left = t.df().where("region_code is null")
    assert left.count() == 18 and left.where("k % 100 not in (1, 3)").isEmpty()
    cell = F.col("geometry.bbox_partitioning")
    assert t.df().where("k % 100 = 1").select(cell.isNotNull().alias("a"), cell["region_code"].isNull().alias("b")).distinct().collect() == [(True, True)]
    assert t.df().where((F.col("k") % 100 == 2) & (F.col("region_code") != 1)).isEmpty()
    t.drop_index()
    assert t.tree() is None and t.df().where("region_code is not null").isEmpty() and t.df().where(cell.isNotNull()).isEmpty()


def other_writer(t, monkeypatch, act):
    """``act`` runs once, right before the table's next snapshot is published."""
    publish, done = GeoTable._publish, []

    def late(self, body):
        if self is t and not done:
            done.append(1)
            act()
        return publish(self, body)

    monkeypatch.setattr(GeoTable, "_publish", late)


@pytest.mark.parametrize("first", ["append", "append_indexed"])
@pytest.mark.parametrize("second", ["append", "append_indexed"])
def test_no_append_is_lost(spark, tmp_path, monkeypatch, first, second):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.append_indexed(rows(spark, 0, 200), 10_000, 50)
    write = lambda t, how, start: getattr(t, how)(rows(spark, start, 200), *([10_000, 50] if how == "append_indexed" else []))
    other_writer(a, monkeypatch, lambda: write(b, second, 2000))
    write(a, first, 1000)
    assert keys(a) == keys(b) == [*range(200), *range(1000, 1200), *range(2000, 2200)]
    tree = a.tree()
    assert all(r.region_code is None or r.region_code in set(tree.nodes()) for r in a.partitions().collect())
    x, y = (F.get(F.col(f"geometry.{c}"), F.lit(0)) for c in "xy")
    inside = lambda t: t.window(1.0, 1.0, 9.0, 6.0).where(x.between(1, 9) & y.between(1, 6)).count()
    assert inside(a) == sum(1 for k in keys(a) if 1 <= k * 7919 % 2003 / 100 <= 9 and 1 <= k * 104729 % 997 / 100 <= 6 and k % 100 not in (1, 2, 3))


def test_rewrites_and_other_writers(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.append_indexed(rows(spark, 0, 300), 10_000, 50)
    other_writer(a, monkeypatch, lambda: b.append(rows(spark, 1000, 100)))
    a.rebuild_index(10_000, 50)  # the new rows stay beside the rewritten ones
    assert keys(a) == [*range(300), *range(1000, 1100)]
    other_writer(a, monkeypatch, b.compact)
    with pytest.raises(ConcurrentWrite):
        a.compact()
    other_writer(a, monkeypatch, lambda: b.append_indexed(rows(spark, 2000, 100), 10_000, 50))
    with pytest.raises(ConcurrentWrite):
        a.drop_index()
    assert keys(a) == [*range(300), *range(1000, 1100), *range(2000, 2100)]
    new = table(spark, tmp_path / "new")
    other_writer(new, monkeypatch, lambda: table(spark, tmp_path / "new").append(rows(spark).withColumn("more", F.lit(1))))
    with pytest.raises(SchemaMismatch):
        new.append(rows(spark))
    assert a.snapshot()["snapshot"] == len(a._ids())


def test_a_tree_grows_alike_at_once_and_bit_by_bit(spark, tmp_path):
    whole, parts = table(spark, tmp_path / "a"), table(spark, tmp_path / "b")
    whole.append_indexed(rows(spark, 0, 2400), 10_000, 60)
    for i in range(3):
        parts.append_indexed(rows(spark, 800 * i, 800), 10_000, 60)
        stats = {r.region_code: r["count"] for r in parts.partitions().collect() if r.region_code is not None}
        tree = parts.tree()
        assert sum(stats.values()) == 800 * (i + 1) * 98 // 100
        assert {c: n for c, n in tree.counts.items() if c != 1} == {c: n for c, n in stats.items() if c != 1}
    assert whole.tree().split == parts.tree().split


def test_overwrite_cells(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append_indexed(rows(spark, 0, 500), 10_000, 60)
    new = spark.range(9000, 9005).select(F.col("id").alias("k"), G.st_point(F.lit(1.5), F.lit(1.5)).alias("geometry"))
    code = t.tree().locate(*box_fit(1.5, 1.5, 1.5, 1.5))
    stay = {r.k for r in t.df().where(f"region_code is null or region_code <> {code}").collect()}
    t.overwrite_cells(new)
    assert set(keys(t)) == stay | set(range(9000, 9005)) and len(stay) < 500
    assert t.manifest().where(f"region_code = {code}").agg(F.sum("rows")).first()[0] == 5
    found = t.manifest().where(f"region_code = {code}").first()
    assert (found.min_x, found.min_y, found.max_x, found.max_y) == Q.cell_bounds(code)

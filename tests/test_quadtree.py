import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.operators import quadtree as Q
from tests.helpers import box_fit


def walk(x1, y1, x2, y2, depth):
    """The tree walk: top left, top right, bottom left, bottom right, all edges included."""
    a, b, c, d, code = -180.0, -90.0, 180.0, 90.0, 1
    if x1 < a or y1 < b or x2 > c or y2 > d:
        return 1
    for _ in range(depth):
        xm, ym = a + (c - a) / 2, b + (d - b) / 2
        if x2 <= xm and y1 >= ym:
            code, c, b = 4 * code + 1, xm, ym
        elif x1 >= xm and y1 >= ym:
            code, a, b = 4 * code, xm, ym
        elif x2 <= xm and y2 <= ym:
            code, c, d = 4 * code + 3, xm, ym
        elif x1 >= xm and y2 <= ym:
            code, a, d = 4 * code + 2, xm, ym
        else:
            return code
    return code


def boxes(n=4000):
    r = random.Random(7)
    out = [(0, 0, 0, 0), (-180, -90, -180, -90), (180, 90, 180, 90), (0, -0.0001, 0, -0.0001), (-1, -1, 1, 1), (-181, 0, 0, 1), (0, 45, 0, 45), (-90, 0, 0, 45)]
    for _ in range(n):
        x, y = (r.choice([r.uniform(-180, 180), 22.5 * r.randint(-8, 7), 360 / 2**11 * r.randint(-900, 900)]), r.choice([r.uniform(-90, 90), 11.25 * r.randint(-8, 7)]))
        w, h = r.choice([0, r.uniform(0, 1e-4), 22.5, r.uniform(0, 30)]), r.choice([0, r.uniform(0, 1e-4), 11.25, r.uniform(0, 20)])
        out.append((x, y, min(x + w, 180), min(y + h, 90)))
    return out


def test_codes_equal_a_tree_walk(spark):
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes()], "a double, b double, c double, d double")
    for depth in (4, 22):
        for r in df.withColumn("code", Q.quad_code("a", "b", "c", "d", depth)).collect():
            assert r.code == walk(*r[:4], depth), r
            path, level = box_fit(*r[:4])
            assert r.code == (1 << 44 | path) >> 2 * (22 - min(level, depth))
    assert [walk(*b, 4) for b in boxes(0)[:5]] == [362, 511, 256, 448, 1]


def test_cells(spark):
    rows = [(c,) for c in (1, 4, 5, 6, 7, 256, 511, 362, 4**22 + 12345)]
    for r in spark.createDataFrame(rows, "code long").select("code", Q.cell_struct("code").alias("s"), Q.level_of("code").alias("l"), Q.parent("code").alias("p")).collect():
        assert tuple(r.s)[:4] == pytest.approx(Q.cell_bounds(r.code), abs=1e-12) and r.s["region_code"] == r.code
        assert r.l == (r.code.bit_length() - 1) // 2 and r.p == r.code >> 2
    for bad in (0, -1, 2, 3, 8, 1 << 46):
        with pytest.raises(ValueError):
            Q.cell_bounds(bad)


def test_sequential_splits():
    tree = Q.Quadtree.initial()
    assert len(tree.nodes()) == 341
    path, level = box_fit(1, 1, 1, 1)
    tree.insert_all([path] * 5, [level] * 5, 2)
    assert {c: n for c, n in tree.counts.items() if n} == {319: 2, 1279: 2, 5119: 1}
    assert tree.locate(path, level) == 5119
    half = Q.Quadtree.initial()
    half.insert_all([path] * 3, [level] * 3, 100, fraction=0.4)  # 2.5 rows each: 2, 3, 2
    assert half.counts[319] == 7
    assert Q.Quadtree.from_json(tree.to_json()) == tree


def test_adaptive_tree(spark):
    r = random.Random(3)
    points = [(r.gauss(13.4, 0.05), r.gauss(52.5, 0.05)) for _ in range(3000)] + [(13.4, 52.5)] * 300 + [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(500)] + [(200.0, 0.0), (None, 1.0)]
    df = spark.createDataFrame(points, "x double, y double").withColumn("b", F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y")))
    for mode in ("balanced", "sequential"):
        tree = Q.build_tree(df, F.col("b"), max_rows=100, mode=mode, order_by=["x", "y"])
        rows = Q.assign(df, F.col("b"), tree).collect()
        counts = {}
        for p in rows:
            if p.x is None:
                assert p.region_code is None
                continue
            assert p.region_code == (1 if p.x > 180 else tree.locate(*box_fit(p.x, p.y, p.x, p.y)))
            counts[p.region_code] = counts.get(p.region_code, 0) + 1
        if mode == "balanced":
            assert max(n for c, n in counts.items() if n and (c.bit_length() - 1) // 2 < 22) <= 100
            tree.correct(counts)
            assert sum(tree.counts.values()) == len(points) - 1
        assert tree.cells(spark).where("not has_children").count() == sum(1 for c in tree.nodes() if c not in tree.split)
        x1, y1, x2, y2 = 13.3, 52.4, 13.45, 52.52
        inside = [p for p in rows if p.x is not None and x1 <= p.x <= x2 and y1 <= p.y <= y2]
        cover, beyond = set(tree.cover(x1, y1, x2, y2)), set(tree.cover_outside(x1, y1, x2, y2))
        assert inside and all(p.region_code in cover for p in inside)
        assert all(p.region_code in beyond for p in rows if p.x is not None and not (x1 <= p.x <= x2 and y1 <= p.y <= y2))
    sampled = Q.build_tree(df, F.col("b"), driver_rows=500, max_rows=100)
    assert sampled.split


def test_deep_trees_need_few_joins(spark):
    """The depth is found by bisection: a tree of 18 levels below the first four is broadcast once and joined five times."""
    tree, path = Q.Quadtree.initial(), 0b011011000110110001101100011011000110110001
    tree.split |= {(1 << 44 | path) >> 2 * (22 - d) for d in range(4, 22)} | {256 + 5, 4 * (256 + 5) + 2}
    r = np.random.default_rng(1)
    paths = np.concatenate([path ^ (r.integers(0, 1 << 44, 500) >> r.integers(0, 45, 500)), r.integers(0, 1 << 44, 200), [path]])
    levels = np.concatenate([r.integers(0, 23, 700), [22]])
    rows = spark.createDataFrame(list(zip(range(701), paths.tolist(), levels.tolist())), "id long, __path long, __level int")
    for split in (tree.split, Q.Quadtree.initial().split, {c for c in tree.split if c < 4**9}):
        got = Q.located(rows, split, "code")
        assert got.columns == [*rows.columns, "code"] and dict(got.select("id", "code").collect()) == dict(enumerate(Q.Quadtree({}, split).locate_all(paths, levels).tolist()))
    assert Q.located(rows, tree.split, "code")._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 5

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geolake.llm import chat
from geolake.llm.topk import choose_pivots, search_block, top_k


def vectors(spark, n=260):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.2, 8)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times
    rows += [(50, rows[50][1]), (2000, None), (2050, [0.1, None] + [0.0] * 6), (2100, [math.nan] + [0.0] * 7), (2150, [math.inf] + [0.0] * 7), (2200, [0.5, 0.5]), (None, rows[1][1]), (2250, [])]
    return rows, spark.createDataFrame([(i, v, 3.0) for i, v in rows], "vec_id long, embedding array<float>, score double")


def test_top_k(spark, monkeypatch):
    rows, table = vectors(spark)
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in sound if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for size in (20_000, 60):
        monkeypatch.setattr("geolake.llm.topk.LEAST", size)
        monkeypatch.setattr("geolake.llm.topk.CANDIDATES", size)
        monkeypatch.setattr("geolake.llm.topk.QUERIES", max(4, size // 10))
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(table, F.col("vec_id") % 50 == 0).collect()]
        assert sorted(got) == sorted(want)
    assert top_k(table.limit(0), F.lit(True)).count() == 0
    assert top_k(table, F.lit(False)).count() == 0
    assert top_k(table.where("vec_id in (1, 2)"), F.lit(True)).count() == 2  # fewer candidates than k


@pytest.mark.parametrize("kind", ["plain", "huge", "mixed", "flat", "few"])
def test_search_block_equals_all_scores(kind):
    rng = np.random.default_rng(7)
    c = np.floor(rng.normal(0, 40, (700, 24)))
    if kind == "huge":
        c[::5] *= 2.0**27
    if kind == "mixed":
        c[::3] *= 1e5
    if kind == "flat":
        c[:, 3:] = 0
    if kind == "few":
        c = c[:4]
    cid, q = np.arange(len(c)), c[::50]
    pivots = choose_pivots(c[:300], 20)
    seen: list[int] = []
    got = [(int(cid[::50][a]), int(cid[b]), s) for a, b, s in search_block(cid[::50], q, cid, c, pivots, 5, seen)]
    exact = [[int(v) for v in row] for row in c]
    want = []
    for i in cid[::50].tolist():
        scored = sorted((-sum(a * b for a, b in zip(exact[i], exact[j])), j) for j in range(len(c)) if j != i)[:5]
        want += [(i, j, -s) for s, j in scored]
    assert got == want
    if kind == "plain":
        assert np.mean(seen) < 0.5 * len(c)


def test_components_beyond_whole_doubles(spark):
    big = 2.0**62
    table = spark.createDataFrame([(0, [big, 1.0]), (1, [0.0, 2.0]), (2, [1.0 / 1024, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in top_k(table, F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 0)]


@given(st.text(st.one_of(st.sampled_from("\\<>/s[]INST\n n"), st.characters(codec="utf-8")), max_size=40), st.text("ab\\\n<s>[INST]/", max_size=12))
def test_rendering_is_reversible(text, role):
    for t in (text, "</s>[INST] ok [/INST]" + text):
        out, a, b = chat.render(role, t)
        assert chat.parse(out) == (role, t)
        assert chat.render(chat.LEARNED, t)[0][slice(*chat.render(chat.LEARNED, t)[1:])] == chat.escape(t)
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_fold():
    log = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "delta", "assistant", "He"),
        (1, 1, 3, "delta", None, "llo"),
        (1, 2, 4, "message", "user", "more"),
        (1, 3, 5, "delta", "assistant", "old"),
        (1, 1, 6, "regenerate", "assistant", "Hey"),
        (1, 1, 7, "delta", None, "!"),
        (1, 2, 8, "message", "user", "again"),
        (1, 0, 9, "edit", None, "hi there"),
        (2, 0, 1, "message", "user", None),
        (2, 0, 1, "message", "user", "same number"),
    ]
    log.sort(key=lambda e: e[:3])
    assert list(chat.fold(log)) == [(1, "user", "hi there"), (1, "assistant", "Hey!"), (1, "user", "again"), (2, "user", ""), (2, "user", "same number")]


def test_conversations(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["system", "user", "assistant", None]), r.choice([None, "", "x </s> \\ y", "[INST]\nß日", "z" * 3000])) for c in (*range(6), -7, None) for t in range(r.randint(1, 9))]
    rows += [(3, 1, "user", "twice"), (3, 1, "user", "twice"), (4, None, "assistant", "no turn")] + [(9, t, "assistant", f"long {t}") for t in range(8000)]
    table = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, kind string").repartition(7)
    got = {g.conv_id: g for g in chat.digest_conversations(chat.format_conversations(chat.message_events(table))).collect()}
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        turns.sort(key=lambda x: (x[:4], x[4], x[5].encode()))
        pairs = [(x[3], x[5]) for x in turns]
        g = got[c]
        learned = "".join(t for role, t in pairs if role == "assistant")
        assert g.n_turns == len(pairs) and g.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render(*p)[0]) for p in pairs)
    assert chat.format_conversations(chat.message_events(table.limit(0))).count() == 0

"""The models against plain ones over dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolake.llm import toxicity as X


def plain_byte_model(words):
    """Interpolated Kneser-Ney of the n-grams of distinct words, keyed by the bytes themselves."""
    table = Counter()
    for w in words:
        w = b"\x02" + w + b"\x03"
        for end in range(2, len(w) + 1):
            for n in range(1, min(X.ORDER, end) + 1):
                table[w[end - n : end]] += 1
    model = []
    for n in range(1, X.ORDER + 1):
        own = [g for g in table if len(g) == n]
        count = {g: table[g] for g in own}
        if n < X.ORDER:
            types = Counter(g[1:] for g in table if len(g) == n + 1)
            count = {g: table[g] if n > 1 and g[:1] == b"\x02" else types[g] for g in own}
        d = X.discount(*(sum(c == x for c in count.values()) for x in (1, 2)))
        total, kinds = Counter(), Counter()
        for g, c in count.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += c > 0
        model.append((count, total, kinds, d))

    def probability(w):
        w, out = b"\x02" + w + b"\x03", 1.0
        for end in range(2, len(w) + 1):
            p = 1 / 256
            for n in range(1, min(X.ORDER, end) + 1):
                count, total, kinds, d = model[n - 1]
                g = w[end - n : end]
                if total[g[:-1]]:
                    p = max(count.get(g, 0) - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * p
            out *= p
        return out

    return probability


def test_bytes():
    r = random.Random(1)
    words = list({"".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(2, 12))).encode() for _ in range(4000)})
    rows = {}
    for batch in X._gram_counts([X._arrays(["word"], X.pa.array(words, X.pa.binary()))]):
        for g, n in zip(*(c.to_pylist() for c in batch.columns)):
            rows[g] = rows.get(g, 0) + n
    order = np.array(sorted(rows), np.int64)
    some = words[:200] + [b"unseen", b"x", "ü日".encode()]
    want = plain_byte_model(words)
    assert np.allclose(np.log(X.ByteModel(order, np.array([rows[g] for g in order.tolist()])).probabilities(some)), [math.log(want(w)) for w in some], atol=1e-6)
    assert X.ByteModel(np.zeros(0, np.int64), np.zeros(0, np.int64)).probabilities([b"a"])[0] > 0


def plain_ratios(rows, i):
    """Ratios of a document's words by dictionaries: rows are (toxic, part, text)."""
    use = [(y, X.words_of(t)) for y, p, t in rows if i or p != X.CALIBRATE]
    every = [(y, X.words_of(t)) for y, _, t in rows]
    count, total = [Counter(), Counter()], [0, 0]
    for y, w in use:
        count[y].update(w)
        total[y] += len(w)
    d = [X.discount(*(sum(c == x for c in count[k].values()) for x in (1, 2))) for k in (0, 1)]

    def strong(c):
        n, e = sum(c), 0.0
        for k in (0, 1):
            e += 2 * c[k] * math.log(c[k] / (n * total[k] / sum(total))) if c[k] else 0
        return n >= X.WORD_COUNT and e >= X.EVIDENCE

    words = {w: (count[0][w], count[1][w]) for w in {*count[0], *count[1]} if strong((count[0][w], count[1][w]))}
    base = plain_byte_model({w for _, ws in every for w in ws})
    left = [1 - sum(max(c[k] - d[k], 0) for c in words.values()) / total[k] for k in (0, 1)]
    one = lambda w, k: max(words.get(w, (0, 0))[k] - d[k], 0) / total[k] + left[k] * base(w)
    two = [Counter(), Counter()]
    for y, w in use:
        two[y].update(zip(w, w[1:]))
    often = Counter(p for y, w in every if y for p in zip(w, w[1:]))
    heard = Counter(w for y, ws in every if y for w in ws)

    def bound(p, n):
        e = heard[p[0]] * heard[p[1]] / sum(heard.values())
        return n >= max(X.PAIR_COUNT, total[1] ** 0.5 / X.PAIR_SCALE) and n > e and 2 * (n * math.log(n / e) - n + e) >= X.COLLOCATION

    pairs = {p: (two[0][p], two[1][p]) for p, n in often.items() if bound(p, n) and strong((two[0][p], two[1][p]))}

    def ratios(ws):
        out = []
        for j, w in enumerate(ws):
            before = ws[j - 1] if j else None
            own = {b: c for (a, b), c in pairs.items() if a == before}
            p = []
            for k in (0, 1):
                share = lambda c: max(c[k] - d[k], 0) / count[k][before] if count[k][before] else 0.0  # noqa: E731, B023
                rest = 1 - sum(map(share, own.values()))
                p.append((share(own[w]) if w in own else 0.0) + rest * one(w, k) if own else one(w, k))
            out.append(math.log(p[1] / p[0]))
        return out

    return ratios, pairs, words


def labelled(n=240):
    r = random.Random(4)
    plain = ["".join(r.choice(("th", "er", "on", "an", "re")) for _ in range(r.randint(1, 3))) for _ in range(60)] + ["paper", "sick", "puppy", "tiger"]
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        w = [r.choice(plain) for _ in range(40)]
        if toxic:  # an insult, and an expression of words that are harmless alone
            w[5:5] = ["oaf"] if i % 2 else ["paper", "tiger"]
        rows.append((toxic, zlib.crc32(str(i).encode()) % 4, " ".join(w)))
    return [x for x in rows if x[1] != X.HELD_OUT]


def test_words_and_expressions(spark):
    rows = labelled()
    model, _ = X.train(spark.createDataFrame([(y, p, t.encode()) for y, p, t in rows], "toxic int, part int, __text binary").repartition(3))
    ratios, pairs, words = plain_ratios([(y, p, t.encode()) for y, p, t in rows], 1)
    assert (b"paper", b"tiger") in pairs and b"oaf" in words
    texts = [t.encode() for _, _, t in rows[:25]] + [b"a paper tiger and paper", b"OAF! paper, then tiger", b"new words", b"", b"tiger paper", "日本 oaf".encode()]
    for t, (mean, top) in zip(texts, model.value.features(texts).tolist()):
        r = ratios(X.words_of(t))
        size = sum(len(w) + 1 for w in X.words_of(t))
        assert math.isclose(mean, sum(r) / size if r else 0.0, abs_tol=1e-6), t
        assert math.isclose(top, sum(sorted(r)[-X.TOP :]) / X.TOP, abs_tol=1e-6), t
    assert model.value.features([b"a paper tiger"])[0, 1] > model.value.features([b"a tiger paper"])[0, 1] + 0.5


def test_odd_labels_and_no_labels(spark):
    docs = spark.createDataFrame([(i, "oaf " * (i % 3) + "word word") for i in range(60)] + [(None, "oaf"), (61, None), (62, "")], "doc_id long, text string")
    odd = spark.createDataFrame([(i, [0, 1, 2, -1, None][i % 5]) for i in range(60)], "doc_id long, toxic int")
    clean = odd.where("toxic in (0, 1)")
    key = lambda rows: sorted(map(repr, rows.select("doc_id", "score", "predicted").collect()))
    assert key(X.score_toxicity(docs, odd)) == key(X.score_toxicity(docs, clean))
    none = X.score_toxicity(docs, odd.where(F.lit(False))).collect()
    assert len(none) == 63 and all(0 <= r.score <= 1 for r in none)


def test_held_out_quality(spark):
    """On the small synthetic corpus: toxic rows of the unseen quarter (some of their labels are noise), and hardly any clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = X.score_toxicity(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.5 * sum(r.toxic for r in rows) and hits >= 0.7 * sum(r.predicted for r in rows)


@pytest.mark.parametrize("words", [50, 1100])
def test_expressions_do_not_depend_on_the_amount_of_text(spark, words):
    r = random.Random(7)
    rows = []
    for i in range(200):
        w = [f"w{r.randrange(300)}" for _ in range(words)]
        rows.append((i % 2, 1, " ".join(w + ["paper", "tiger"] * (i in (1, 3, 5))).encode()))
    model, _ = X.train(spark.createDataFrame(rows, "toxic int, part int, __text binary").repartition(3))
    paper, tiger = X.hash_words([b"paper", b"tiger"]).tolist()
    assert tiger in model.value.behind.get(paper, (0, {}))[1]

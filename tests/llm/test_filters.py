import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from geolake.llm.decontaminate import ItemAutomaton, cut_spans, find_leaks, words_of
from geolake.llm.toxicity import score_toxicity
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(words, items, size):
    windows = {}
    for name, own in items:
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add(name)
    hit, names = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names |= windows[tuple(words[i : i + n])]
    return hit, names


def test_words():
    text = "Ab-c's Été_x 12\x7fZ\x00{q}"
    assert [w.decode() for w in words_of(text.encode())] == split(text)


def test_automaton_against_brute_force():
    r = random.Random(3)
    letters = [b"a", b"b", b"c"]
    for _ in range(200):
        items = [(str(k), [r.choice(letters) for _ in range(r.randint(0, 9))]) for k in range(4)]
        texts = [[r.choice([*letters, b"z"]) for _ in range(r.randint(0, 40))] for _ in range(5)]
        for words, (spans, names, _) in zip(texts, ItemAutomaton(items, 4).match(texts)):
            assert ({i for a, b in spans for i in range(a, b)}, names) == brute(words, items, 4)


def test_leaks(spark, corpus, no_docs, monkeypatch):
    texts = dict(corpus.where("doc_id is not null").select("doc_id", "text").collect())
    items = [(1, " ".join(texts[3].split()[5:40])), (2, "of the"), (3, None), (4, ""), (5, texts[4][:200]), (5, texts[4][:200]), (None, texts[9]), (6, "!!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    coded = [(str(i), split(t)) for i, t in items if i is not None]

    def check(rows):
        for r in rows:
            words = split(r.text)
            hit, names = brute(words, coded, 10)
            assert {i for a, b in r.hits for i in range(a, b)} == hit and r["items"] == sorted(names) and r.n_words == len(words)
            left = split(r.cleaned)
            assert r.cleaned is None or not hit or len(left) <= len(words) - len(hit) + len(r.hits)

    rows = find_leaks(corpus, table, cleaned_col="cleaned").collect()
    assert len(rows) == corpus.count() and sum(bool(r.hits) for r in rows) > 3
    check(rows)
    monkeypatch.setattr("geolake.llm.decontaminate.BLOCK", 100)  # more passes than one
    check(find_leaks(corpus, table, cleaned_col="cleaned").collect())
    assert find_leaks(no_docs, table).count() == 0
    assert find_leaks(corpus, table.limit(0)).where(F.size("hits") > 0).count() == 0
    assert find_leaks(corpus, table, cleaned_col="c", max_coverage=0.0).where((F.size("hits") > 0) & F.col("c").isNotNull()).count() == 0


def test_cut_spans_keeps_what_is_around():
    assert cut_spans(b"One, two; three! Four.", [[1, 3]]) == b"One, ! Four."


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxicity_on_held_out_rows(spark, corpus, no_docs):
    r = random.Random(1)
    bad = ["scumbag", "idiotic", "worthless", "loserly", "trashy"]
    rows, labels = [], []
    for i in range(700):
        words = prose(i, r.randint(20, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", "s", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 50 else None))
    labels += [(0, 1), (0, 0), (None, 1), (99_999, 1)]
    docs = spark.createDataFrame([*rows, (None, "x"), (5000, None), (5001, ""), (5001, "")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    got = score_toxicity(docs.withColumn("score", F.lit(1)), table).collect()
    assert len(got) == docs.count() and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    assert all(g.held_out == (g.doc_id is not None and held(g.doc_id)) for g in got)
    out = [g for g in got if g.held_out and g.doc_id < 700]
    assert auc(np.array([g.score for g in out]), np.array([int(g.doc_id % 4 == 0) for g in out])) > 0.97
    again = score_toxicity(docs, table.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()
    assert sorted((g.doc_id or -1, g.score) for g in got) == sorted((g.doc_id or -1, g.score) for g in again)  # held-out labels do not matter
    assert score_toxicity(no_docs, table).count() == 0
    assert score_toxicity(corpus, table.limit(0)).count() == corpus.count()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

import random

import numpy as np
import pytest

import corpus_pipeline
from geolake.llm.similar import band_keys, shingle_set, similar_documents, tree_pairs
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows):
    """The smallest id of each document's component, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))) and jaccard(a, b) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def edited(text, r, edits):
    w = text.split()
    for k in r.sample(range(len(w)), edits):
        w[k] = f"new{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("fillers", [0, 20_000])
def test_pairs_near_the_threshold_at_two_sizes(spark, fillers):
    """Whatever the table's size every pair at 0.8 and above is found, and none below."""
    r = random.Random(3)
    rows = []
    for i in range(250):
        base = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
        rows += [(2 * i, base), (2 * i + 1, edited(base, r, r.choice((2, 3, 4, 5, 6))))]
    want = brute(rows)
    near = [jaccard(shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])) for i in range(250)]
    assert sum(0.8 <= s < 0.85 for s in near) > 20 and sum(0.75 <= s < 0.8 for s in near) > 20
    more = [(10_000 + i, " ".join(f"w{r.randrange(10**6)}" for _ in range(12))) for i in range(fillers)]
    got = dict(similar_documents(spark.createDataFrame([*rows, *more], "doc_id long, text string")).where("doc_id < 10000").collect())
    assert got == want


def test_repeated_line_is_no_similarity(spark):
    line = "the same line over and over again in both of them "
    rows = [(i, line * 60 + prose(50 + i, 120)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang")
    assert set(brute(rows).values()) == {0, 1, 2, 3}
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == 4


def test_groups_whose_first_member_links_to_few(spark, corpus):
    """Chains and groups: links that the first member of a key does not have."""
    r = random.Random(5)
    rows, text = [], prose(1, 150)
    for i in range(40):
        rows.append((1000 + i, text))
        text = edited(text, r, 2)
    centre = prose(2, 100)
    rows += [(2000 + i, edited(centre, r, 2 + i % 3)) for i in range(60)]
    seen = {(g.doc_id, g.text) for g in corpus.where("doc_id is not null").collect()}
    rows += sorted(seen, key=lambda x: x[0])
    got = dict(similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_band_keys_of_equal_and_large_sets():
    s = [shingle_set(prose(i, n).encode(), 5) for i, n in ((1, 5), (2, 60_000), (1, 5), (3, 50))]
    k = band_keys(s)
    assert (k[0] == k[2]).all() and len(np.unique(k)) == 3 * k.shape[1]


def test_pairs_come_from_the_trees_of_keys():
    """Items far from a key's first one meet each other in its BK-tree; keys are not mixed, sizes count, the root meets all."""
    far = 2**40 - 1
    fp = np.array([0, far, far ^ 1, 3, far, far ^ 1], np.uint64).reshape(-1, 1)
    key, n = np.array([5, 5, 5, 5, 9, 9]), np.array([10, 10, 10, 10, 10, 7])
    a, b = tree_pairs(key, n, fp, 0.8)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 3)}  # edges 40 and 39: two branches
    fp[2] = far ^ 1 ^ 2**50
    a, b = tree_pairs(key, n, fp, 0.8)
    assert set(zip(a.tolist(), b.tolist())) == {(1, 2), (0, 3)}
    n[5] = 8
    assert set(zip(*(x.tolist() for x in tree_pairs(key, n, fp, 0.8)))) == {(1, 2), (0, 3), (4, 5)}
    assert [len(x) for x in tree_pairs(key[:0], n[:0], fp[:0], 0.8)] == [0, 0]
    fp, m = np.repeat(np.array([[0], [far], [far ^ 1]], np.uint64), [1, 20_000, 20_000], axis=0), 20_000
    a, b = tree_pairs(np.zeros(2 * m + 1, np.int64), np.full(2 * m + 1, 9), fp, 0.8)  # no chain of equal ones
    assert b.tolist() == [*range(2, m + 1), *range(m + 2, 2 * m + 1)] and set(a.tolist()) == {1, m + 1}

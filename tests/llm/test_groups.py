import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import functions as F

from geolake.llm.sharding import minimax_cuts, shard_documents
from geolake.llm.simhash import bk_components, fingerprint_batch, near_duplicates, similarity_radius
from geolake.llm.substring_dedup import Parse, remove_repeats
from tests.llm.conftest import prose


def least_capacity(sizes, n):
    def fits(cap):
        shards, room = 0, 0
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                shards, room = shards + 1, cap
            room -= s
        return shards <= n

    lo, hi = 0, sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def test_capacity_is_the_smallest(spark):
    r = random.Random(5)
    for n, top in ((40, 10), (3000, 50), (3000, 5000), (5, 9)):
        rows = [(hashlib.sha256(f"{n}-{top}-{i}".encode()).hexdigest()[:32], r.choice([1, r.randint(1, top), top * 40 if i == 3 else 2])) for i in range(n)]
        cuts, capacity = minimax_cuts(spark.createDataFrame(rows, "key string, bytes long"), 7)
        sizes = [b for _, b in sorted(rows)]
        assert capacity == least_capacity(sizes, 7)
        assert max(sum(b for k, b in rows if sum(k >= c for c in cuts) == s) for s in range(7)) <= capacity


def test_shards(spark, corpus, no_docs):
    got = shard_documents(corpus, 4).collect()
    texts = sorted((i is None, i or 0, t or "") for i, t in corpus.select("doc_id", "text").collect())
    assert len(got) == len(texts)
    size = {}
    for g in got:
        size.setdefault(g.shard, []).append(g)
    for rows in size.values():
        assert sorted(g.slot for g in rows) == list(range(len(rows)))
    crc = {}
    for g in got:
        assert crc.setdefault((g.text_crc32, g.size), g.shard) == g.shard and g.law == "bytes" and g.grown_shard is None
    assert sorted((g.doc_id is None, g.doc_id or 0, g.text_crc32, g.size) for g in got) == sorted((n, i, zlib.crc32(t.encode()), len(t.encode()) + 1) for n, i, t in texts)
    groups = {}
    for _, _, t in texts:
        k = hashlib.sha256(t.encode()).hexdigest()[:32]
        groups[k] = groups.get(k, 0) + len(t.encode()) + 1
    assert max(sum(g.size for g in rows) for rows in size.values()) == least_capacity([b for _, b in sorted(groups.items())], 4)
    assert shard_documents(no_docs).count() == 0


def slow_fingerprint(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_trees_find_all_components():
    rng = np.random.default_rng(1)
    for width, radius in ((1, 3), (4, 30)):
        centres = rng.integers(0, 2**63, (6, width), dtype=np.uint64)
        fps = [centres[i % 6] ^ sum((np.eye(1, width, int(b) // 64, dtype=np.uint64)[0] << np.uint64(b % 64) for b in rng.choice(64 * width, rng.integers(0, 2 * radius), replace=False)), np.zeros(width, np.uint64)) for i in range(400)]
        fps = np.unique(np.array(fps, np.uint64), axis=0)
        shard = np.sort(rng.integers(0, 3, len(fps)))
        label = bk_components(fps, shard, radius)
        want = components(range(len(fps)), lambda a, b: shard[a] == shard[b] and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= radius)
        assert [int(x) for x in label] == [want[i] for i in range(len(fps))]


def test_near_duplicates(spark, corpus, no_docs):
    got = near_duplicates(corpus).collect()
    rows = corpus.select("doc_id", "text").collect()
    fp = {t: slow_fingerprint(t, 3) for _, t in rows}
    assert sorted((g.doc_id is None, g.doc_id or 0, bytes(g.fp).hex()) for g in got) == sorted((i is None, i or 0, f"{fp[t]:016x}") for i, t in rows)
    own = {}
    for i, t in rows:
        if i is not None:
            own.setdefault(fp[t], set()).add(i)
    label = components(own, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for f, c in label.items():
        least[c] = min(least.get(c, 1 << 62), min(own[f]))
    for g in got:
        f = int.from_bytes(g.fp, "big")
        assert g.component_id == (least[label[f]] if f in own else None)
    assert near_duplicates(no_docs).count() == 0
    wide = near_duplicates(corpus, words=5, bits=256, radius=similarity_radius(0.8, 256)).collect()
    assert {(g.doc_id, g.component_id) for g in wide} >= {(100 + i, i) for i in range(8)}
    assert fingerprint_batch([b"", b"a b"], 3, 256).shape == (2, 4)


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49) if i is not None else ():
            w = t[p : p + 50]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49) if i is not None else ():
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i is None, i or 0, bytes(b for b, g in zip(t, gone) if not g), len(bytes(gone).strip(b"\0").split(b"\0")) if any(gone) and b"\0" not in bytes(gone).strip(b"\0") else sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)))
    return sorted(out)


def test_repeats_against_brute_force(spark, corpus, no_docs, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in corpus.select("doc_id", "text").collect()]
    more = [(400, prose(1, 60)), (401, "q" * 49), (402, "q" * 50), (403, "ab" * 60), (404, "ba" * 60), (405, "é" * 30 + "x"), (406, "é" * 30 + "y"), (407, prose(1, 60)[3:])]
    table = corpus.select("doc_id", "text", F.lit(1).alias("spans")).unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("spans", F.lit(1)))
    want = brute_repeats([*rows, *((i, t.encode()) for i, t in more)])
    for chunk, ranges in ((8_000_000, 4), (9_000, 4), (9_000, Fraction(1, 30))):  # the last: more ranges than a chunk has phrases
        monkeypatch.setattr("geolake.llm.substring_dedup.CHUNK", chunk)
        monkeypatch.setattr("geolake.llm.substring_dedup.CHUNKS", ranges)
        got = remove_repeats(table).collect()
        assert sorted((g.doc_id is None, g.doc_id or 0, bytes(g.kept), len(g.spans)) for g in got) == want
    assert remove_repeats(no_docs).count() == 0
    cleaned = remove_repeats(table, cleaned_col="text")
    assert cleaned.columns[-2:] == ["text", "spans"]
    assert sorted((g.doc_id is None, g.doc_id or 0, g.text) for g in cleaned.collect()) == sorted((n, i, b.decode("utf-8", "ignore")) for n, i, b, _ in want)


def test_every_window_has_a_trigger():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 200_000).astype(np.uint8)
    ends = np.sort(rng.choice(200_000, 300, replace=False))
    ends[-1] = len(data)
    p = Parse(data, ends)
    covered = np.zeros(len(data), bool)
    for lo, hi in zip(p.lo, p.hi):
        covered[lo : hi - 49] = True  # window starts
    start = np.r_[0, ends[:-1]]
    for a, b in zip(start, ends):
        assert covered[a : max(a, b - 49)].all()

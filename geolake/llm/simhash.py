"""SimHash near-duplicates: fingerprints, BK-trees by shard, components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.llm._common import checkpoint, connected_components, hold, release_memory, utf8
from geolake.llm.bpe import small_batches

#: Shards by (number of bit blocks, blocks that must agree): a radius of 3 leaves at least `agree` of `blocks` untouched.
SCHEMES = ((4, 1), (5, 2), (6, 3), (7, 4))
#: A scheme is taken if its keys would each hold at most so many random fingerprints.
FULL = 8
#: Shards of wide fingerprints are samples of their bits, so many that at most this share of the pairs at the radius meets in none.
MISSED = 1e-3
#: Pairs of query and tree node that are looked at together.
FRONT = 500_000


def fingerprint_batch(texts: list[bytes], words: int, bits: int = 64) -> np.ndarray:
    """SimHash of each text, as ``bits / 64`` numbers: bit by bit the majority of the XXH64 (seed 42) of its shingles.

    More than 64 bits come from the same hash, mixed with a constant for each further number. A text without words gets zero.
    """
    width = bits // 64
    out = np.zeros((len(texts), width), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        h = np.array(hashes, np.uint64)
        edges = np.array([*starts, len(h)])
        for s in range(0, len(rows), 256):
            e = min(s + 256, len(rows))
            part = h[edges[s] : edges[e]]
            for k in range(width):
                if k:
                    part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    part ^= part >> np.uint64(29)
                one = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(one, edges[s:e] - edges[s], axis=0, dtype=np.int32)
                n = np.diff(edges[s : e + 1])
                out[rows[s:e], k] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        w = text.lower().split()  # of bytes: A-Z only, and splits at \x20 and \x09-\x0D
        if not w:
            continue
        rows.append(i)
        starts.append(len(hashes))
        if len(w) < words:
            hashes.append(digest(b" ".join(w), 42))
        else:
            hashes.extend([digest(x, 42) for x in map(b" ".join, zip(*(w[j:] for j in range(words))))])
        if len(hashes) > 100_000:
            flush()
    if rows:
        flush()
    return out


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` (binary, most significant byte first): the SimHash of every whole text; zero without words (null, empty)."""

    def run(batches):
        hold("simhash", None, object)
        for b in small_batches(batches):
            fp = fingerprint_batch(b.column(1).to_pylist(), words, bits).astype(">u8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in fp], pa.binary())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "id long, fp binary").withColumnRenamed("id", id_col)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each item's component."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        new = label.copy()
        for of in (label[a], label[b], a, b):
            np.minimum.at(new, of, m)
        while not ((jumped := new[new]) == new).all():
            new = jumped
        if (new == label).all():
            break
        label = new
    return label


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _bk_trees(fps: np.ndarray, root: np.ndarray, radius: int):
    """BK-trees of items with the same ``root``: parent, edge and depth of each item, and the links met on the way."""
    n, span = len(fps), 64 * fps.shape[1] + 1
    parent, edge, depth = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(root != np.arange(n))
    at, level, links = root[live], 0, [(np.zeros(0, int), np.zeros(0, int))]
    while len(live):
        level += 1
        d = _distance(fps[live], fps[at])
        links.append((live[d <= radius], at[d <= radius]))
        key = at * span + d
        order = np.argsort(key, kind="stable")
        live, key, at, d = live[order], key[order], at[order], d[order]
        new = np.r_[True, key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        child = live[new]
        parent[child], edge[child], depth[child] = at[new], d[new], level
        live, at = live[~new], live[head][~new]
    return parent, edge, depth, links


def bk_pairs(fps: np.ndarray, radius: int):
    """All pairs of items within ``radius`` bits, (larger index, smaller index), some at a time: each is searched for in one BK-tree."""
    n = len(fps)
    if n < 2:
        return
    span = 64 * fps.shape[1] + 1
    parent, edge, _, _ = _bk_trees(fps, np.zeros(n, np.int64), radius)
    kids = np.flatnonzero(parent >= 0)
    key = parent[kids] * span + edge[kids]
    order = np.argsort(key)
    kids, key = kids[order], key[order]
    stack = [(np.arange(n)[s : s + FRONT], np.zeros(len(range(n)[s : s + FRONT]), np.int64)) for s in range(0, n, FRONT)]
    while stack:
        q, node = stack.pop()
        d = _distance(fps[q], fps[node])
        hit = (d <= radius) & (q > node)
        if hit.any():
            yield q[hit], node[hit]
        lo = np.searchsorted(key, node * span + np.maximum(d - radius, 0))
        count = np.searchsorted(key, node * span + np.minimum(d + radius, span - 1), side="right") - lo
        cut = np.flatnonzero(np.diff(np.cumsum(count) // FRONT)) + 1  # about FRONT children at once
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(q)]):
            some = count[a:b]
            if some.sum():
                pick = np.repeat(lo[a:b] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum())
                stack.append((np.repeat(q[a:b], some), kids[pick]))


def bk_components(fps: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """Components of fingerprints that lie within ``radius`` bits of each other in the same shard.

    ``fps`` has a row of 64-bit numbers for each item, distinct within a shard; ``shard`` is sorted. Builds one BK-tree per shard, level
    by level for all shards at once: each item steps to the child whose edge is its distance to the current node, and
    the first to find no child becomes it. Each item is then searched for in its tree along edges within the
    radius only. Subtrees that already belong wholly to the item's component are left out, so that a dense group of m
    near copies costs about m steps instead of m * m. Returns the smallest index of each component.
    """
    n = len(fps)
    if n < 2:
        return np.arange(n)
    span = 64 * fps.shape[1] + 1
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, n]))
    parent, edge, depth, links = _bk_trees(fps, root, radius)
    label = _labels(n, *map(np.concatenate, zip(*links)))
    least, most = label.copy(), label.copy()
    by_depth = np.argsort(-depth, kind="stable")
    for rows in np.split(by_depth, np.flatnonzero(np.diff(-depth[by_depth])) + 1):
        rows = rows[parent[rows] >= 0]
        np.minimum.at(least, parent[rows], least[rows])
        np.maximum.at(most, parent[rows], most[rows])
    kids = np.flatnonzero(parent >= 0)
    key = parent[kids] * span + edge[kids]
    order = np.argsort(key)
    kids, key = kids[order], key[order]
    stack = [(np.arange(n)[s : s + FRONT], root[s : s + FRONT]) for s in range(0, n, FRONT)]
    while stack:
        q, node = stack.pop()
        if len(q) > FRONT:
            half = len(q) // 2
            stack += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        keep = (least[node] != label[q]) | (most[node] != label[q])
        q, node = q[keep], node[keep]
        if not len(q):
            continue
        d = _distance(fps[q], fps[node])
        hit = d <= radius
        links.append((q[hit], node[hit]))
        lo = np.searchsorted(key, node * span + np.maximum(d - radius, 0))
        count = np.searchsorted(key, node * span + np.minimum(d + radius, span - 1), side="right") - lo
        cut = np.flatnonzero(np.diff(np.cumsum(count) // FRONT)) + 1  # about FRONT children at once
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(q)]):
            some = count[a:b]
            pick = np.repeat(lo[a:b] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum())
            stack.append((np.repeat(q[a:b], some), kids[pick]))
    return _labels(n, *map(np.concatenate, zip(*links)))


def shard_masks(n: int, bits: int, radius: int) -> np.ndarray:
    """Masks whose bits make up the shard keys, for ``n`` fingerprints.

    Up to 64 bits and a radius of 3, every two fingerprints within the radius agree under some mask: each
    is a choice of ``agree`` out of ``agree + 3`` bit blocks. Otherwise the masks are fixed random samples of about log2(n) + 2 bits,
    and their number grows as they widen, so that the share of pairs that meet does not depend on n.
    """
    if bits == 64 and radius <= 3:
        blocks, agree = next((s for s in SCHEMES if n / 2.0 ** (64 * s[1] / s[0]) <= FULL), SCHEMES[-1])
        at = [64 * i // blocks for i in range(blocks + 1)]
        block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:])]
        return np.array([[sum(c)] for c in combinations(block, agree)], np.uint64)
    rng = np.random.default_rng(42)
    size = min(max(16, math.ceil(math.log2(max(n, 2))) + 2), bits // 4)
    agree = math.comb(bits - radius, size) / math.comb(bits, size)  # that a sample holds none of ``radius`` bits
    samples = math.ceil(math.log(MISSED) / math.log1p(-agree)) if agree < 1 else 1
    masks = np.zeros((samples, bits // 64), np.uint64)
    for m in masks:
        for i in rng.choice(bits, size, replace=False).tolist():
            m[i // 64] |= np.uint64(1 << (i % 64))
    return masks


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    values = np.frombuffer(column.buffers()[2], np.uint8)
    start = 8 * width * column.offset if not len(column) else int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return values[start : start + 8 * width * len(column)].view(">u8").astype(np.uint64).reshape(-1, width)


def fingerprint_links(nodes: DataFrame, bits: int = 64, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between nodes (``node`` long, ``fp`` binary, distinct) that span the components of all pairs that share a shard and lie within ``radius``.

    Each fingerprint goes to one shard for each mask (:func:`shard_masks`) and meets its partners there; the number of key bits
    follows from the number of fingerprints, so that a shard of unrelated ones stays small at any size. Trees are built where
    their shard is and nothing is broadcast. Each shard gives a star, (a, b) with b one node of the component: fewer rows than members.
    """
    width = bits // 64
    masks = shard_masks(nodes.count(), bits, radius)

    def deal(batches):
        salt = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for s in range(0, b.num_rows, 5_000):
                part = b.slice(s, 5_000)
                fp = _numbers(part.column(1), width)
                key = np.zeros((part.num_rows, len(masks)), np.uint64)
                for k in range(width):
                    key = (key ^ (fp[:, k, None] & masks[:, k])) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                key = (key + salt).view(np.int64).ravel()
                take = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(take), part.column(1).take(take)], names=["key", "node", "fp"])

    def run(batches):
        held: list[tuple] = []
        size = 0

        def solve(key, node, fp):
            twin = np.r_[False, key[1:] == key[:-1]]
            grouped = twin | np.r_[twin[1:], False]
            key, node, fp = key[grouped], node[grouped], fp[grouped]
            label = bk_components(fp, key, radius)
            off = label != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(node[label[off]])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _numbers(b.column(2), width)))
            size += b.num_rows
            if size >= 200_000:
                key, node, fp = (np.concatenate(c) for c in zip(*held))
                cut = np.searchsorted(key, key[-1])  # the last shard may go on
                if cut:
                    yield solve(key[:cut], node[:cut], fp[:cut])
                    held = [(key[cut:].copy(), node[cut:].copy(), fp[cut:].copy())]
                    size = len(held[0][0])
        if held:
            yield solve(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        release_memory()

    dealt = nodes.select("node", "fp").mapInArrow(deal, "key long, node long, fp binary")
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def similarity_radius(similarity: float, bits: int) -> int:
    """The bits in which SimHashes of two shingle sets of this Jaccard similarity differ on average."""
    return round(bits * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id``: each document's fingerprint and the smallest id reachable over links.

    Equal fingerprints are one node, so copies are never paired. Texts without words have fingerprint zero and are linked
    like any other. A row with a null id takes the component of the rows with its fingerprint, null if none
    of them has an id. Repeated ids give repeated rows. An empty table gives no rows.
    """
    rows = checkpoint(fingerprints(docs, words, bits, id_col, text_col))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("node")))
    labels = connected_components(fingerprint_links(nodes.where("node is not null"), bits, radius))
    component = nodes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return rows.join(component, "fp").select(id_col, "fp", "component_id")

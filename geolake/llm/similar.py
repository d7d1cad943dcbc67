"""Near-duplicates by the similarity of shingle sets.

MinHash keys deal the sets into shards, so that similar ones meet in one whatever the table's size; within a shard pairs are proposed by
SimHash fingerprints of FINGERPRINT bits, searched for in a BK-tree along edges within a radius; the whole sets decide them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.llm._common import checkpoint, connected_components, hold, release_memory, utf8
from geolake.llm.bpe import small_batches
from geolake.llm.simhash import _bk_trees, bk_pairs, similarity_radius

#: Keys of a set, and minima in each. Two sets of similarity s share no key with (1 - s**MINIMA)**BANDS: 5e-6 at 0.8, at any table size.
BANDS, MINIMA = 40, 6
#: Bits of a fingerprint, and standard deviations above the mean distance at the similarity that still propose a pair: 3e-7 of the pairs lie beyond.
FINGERPRINT, BEYOND = 64, 5.0
#: Parts of a set's comparisons, so that a very common one is more than one task's work.
PARTS = 64
_FP = [f"f{k}" for k in range(FINGERPRINT // 64)]
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 of the shingles of a text, in order; of all its words where they are fewer."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w))], np.uint64)
    hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[j:] for j in range(words))))))
    return np.unique(np.array(hashes, np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set (none of them empty)."""
    rng = np.random.default_rng(42)
    xor, odd = rng.integers(0, 2**64, (2, BANDS * MINIMA), np.uint64)
    odd |= np.uint64(1)
    out = np.zeros((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 50_000):
            size += len(sets[to])
            to += 1
        h = np.concatenate(sets[at:to])
        first = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(BANDS * MINIMA):
            least = np.minimum.reduceat((h ^ xor[k]) * odd[k], first)
            key = (out[at:to, k // MINIMA] ^ least) * _MUL
            out[at:to, k // MINIMA] = key ^ (key >> np.uint64(32))
        at = to
    return out + np.arange(BANDS, dtype=np.uint64) * _MUL


def fingerprint(s: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes: bit by bit the majority, more than 64 bits by mixing with a constant."""
    out, part = np.zeros(FINGERPRINT // 64, np.uint64), s
    for k in range(len(out)):
        if k:
            part = (part ^ (part >> np.uint64(31))) * _MUL
            part ^= part >> np.uint64(29)
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0]
    return out


def proposal_radius(similarity: float) -> int:
    """Bits within which all but a share of 3e-7 of the pairs of this similarity lie (a bit differs with probability p, independently)."""
    p = similarity_radius(similarity, FINGERPRINT) / FINGERPRINT
    return min(FINGERPRINT, round(FINGERPRINT * p + BEYOND * (FINGERPRINT * p * (1 - p)) ** 0.5))


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """``id, hi, lo, n, f0, f1, keys``: of each text the 128-bit digest, size, fingerprint and band keys of its shingle set."""

    def run(batches):
        hold("similar", None, object)
        for b in small_batches(batches):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            for i, k in zip(some, band_keys([sets[i] for i in some])):
                keys[i] = k.tobytes()
            n = np.array([len(s) for s in sets], np.int32)
            fp = np.array([fingerprint(s) for s in sets], np.uint64).reshape(len(sets), -1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(n), *[pa.array(fp[:, k].copy()) for k in range(len(_FP))], pa.array(keys, pa.binary())], names=["id", "hi", "lo", "n", *_FP, "keys"])

    return docs.mapInArrow(run, f"id long, hi long, lo long, n int, {', '.join(f'{c} long' for c in _FP)}, keys binary")


_PAIR = ["ahi", "alo", "anode", "bhi", "blo", "bnode"]


def _by_key(classes: DataFrame, solve, schema: str) -> DataFrame:
    """Rows from ``solve(key, node, hi, lo, comp, n, fingerprints)`` over whole keys, each key's classes in the order of their nodes."""

    columns = ["node", "hi", "lo", "comp", "n", *_FP]

    def deal(batches):
        for b in batches:
            for s in range(0, b.num_rows, 5_000):
                part = b.slice(s, 5_000)
                key = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64)
                take = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(take) for c in part.columns[1:])], names=["key", *columns])

    def whole(cols):
        return solve(*cols[:6], np.column_stack(cols[6:]).view(np.uint64))

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= 200_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                cut = np.searchsorted(cols[0], cols[0][-1])  # the last key may go on
                if cut:
                    yield from whole([c[:cut] for c in cols])
                held, size = [[c[cut:].copy() for c in cols]], len(cols[0]) - cut
        if held:
            yield from whole([np.concatenate(c) for c in zip(*held)])
        held.clear()
        release_memory()

    dealt = classes.where("keys is not null").select("keys", *columns).mapInArrow(deal, ", ".join(f"{c} {'int' if c == 'n' else 'long'}" for c in ["key", *columns]))
    return dealt.repartition("key").sortWithinPartitions("key", "node", "hi", "lo").mapInArrow(run, schema)


def tree_pairs(key: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (node, item) met as a BK-tree of the fingerprints is built for each key (in order), its first item the root.

    Each item meets the nodes on its way down; it is paired with the first one whose fingerprint (within :func:`proposal_radius`) and size allow
    the similarity. The root meets all others, so no pair of it is left out.
    """
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((*fp.T, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (fp[order][1:] != fp[order][:-1]).any(axis=1)]
    rep = np.empty(len(key), np.int64)  # equal fingerprints of a key are one node, that of the first item: else they would be a chain
    rep[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    reps, of, count = np.unique(rep, return_inverse=True, return_counts=True)
    root = np.maximum.accumulate(np.where(np.r_[True, key[reps][1:] != key[reps][:-1]], np.arange(len(reps)), 0))
    low, high = map(np.concatenate, zip(*_bk_trees(fp[reps], root, proposal_radius(similarity))[3]))  # level by level
    members, times = np.argsort(of, kind="stable"), count[low]
    at = np.repeat((np.cumsum(count) - count)[low] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    twins = np.flatnonzero(rep != np.arange(len(key)))
    item, node = np.r_[members[at], twins], np.r_[np.repeat(reps[high], times), rep[twins]]
    some = np.minimum(n[item], n[node]) >= similarity * np.maximum(n[item], n[node]) * (1 - 1e-12)
    item, first = np.unique(item[some], return_index=True)
    return node[some][first], item


def _tree_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes that :func:`tree_pairs` proposes."""

    def solve(key, node, hi, lo, comp, n, fp):
        pairs = tree_pairs(key, n, fp, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(c[i]) for i in pairs for c in (hi, lo, node)], names=_PAIR)

    return _by_key(classes, solve, ", ".join(f"{c} long" for c in _PAIR)).distinct()


def _crowds(classes: DataFrame) -> DataFrame:
    """``key, node, hi, lo, comp`` and fingerprints: the classes after each key's first one, where they are of several components."""

    def solve(key, node, hi, lo, comp, n, fp):
        later = np.flatnonzero(np.r_[False, key[1:] == key[:-1]])
        if not len(later):
            return
        own, parts = key[later], comp[later]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        mixed = np.minimum.reduceat(parts, first) != np.maximum.reduceat(parts, first)
        i = later[np.repeat(mixed, np.diff(np.r_[first, len(own)]))]
        yield pa.RecordBatch.from_arrays([pa.array(c[i]) for c in (key, node, hi, lo, comp, *fp.view(np.int64).T.copy())], names=["key", "node", "hi", "lo", "comp", *_FP])

    return _by_key(classes, solve, ", ".join(f"{c} long" for c in ["key", "node", "hi", "lo", "comp", *_FP]))


def _sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``hi, lo, s``: the shingle sets of the texts of ``nodes`` (``node``)."""

    def run(batches):
        hold("similar", None, object)
        for b in small_batches(batches):
            own = [shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()]
            name = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, own)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(own, pa.binary())], names=["hi", "lo", "s"])

    rows = docs.join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi").mapInArrow(run, "hi long, lo long, s binary")
    return checkpoint(rows.groupBy("hi", "lo").agg(F.first("s").alias("s")))


def crowd_links(comp: np.ndarray, sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Index pairs with the similarity that join all components (``comp``) of the sets which have such a pair between them.

    Pairs within the radius come from a BK-tree of the fingerprints; those of one component are left out, the others compared whole.
    """
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    value, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    comp, links = comp.copy(), []
    here = np.zeros(len(value), bool)
    for larger, smaller in bk_pairs(fps, proposal_radius(similarity)):
        order = np.argsort(larger, kind="stable")
        larger, smaller = larger[order], smaller[order]
        edges = np.r_[np.flatnonzero(np.r_[True, larger[1:] != larger[:-1]]), len(larger)]
        for x, y in zip(edges, edges[1:]):
            i, j = larger[x], smaller[x:y]
            j = j[comp[j] != comp[i]]
            j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) * (1 - 1e-12)]
            if not len(j):
                continue
            own = shingle[first[i] : first[i] + size[i]]
            here[own] = True
            at = np.cumsum(size[j]) - size[j]
            both = np.add.reduceat(here[shingle[np.repeat(first[j] - at, size[j]) + np.arange(size[j].sum())]], at, dtype=np.int64)
            here[own] = False
            for k in j[both >= similarity * (size[i] + size[j] - both) * (1 - 1e-12)].tolist():
                if comp[k] != comp[i]:
                    links.append((int(i), k))
                    comp[comp == comp[k]] = comp[i]
    return links


def _crowd_links(crowds: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``a, b`` between the components of each key's classes, by a BK-tree for each key."""

    def run(batches):
        last, held = None, []

        def solve():
            comp = np.array([c for _, c, _, _ in held])
            links = crowd_links(comp, [s for *_, s in held], np.array([f for _, _, f, _ in held], np.int64).view(np.uint64), similarity)
            a, b = ([held[x[k]][0] for x in links] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            for key, node, comp, *fp, s in zip(*(c.to_pylist() for c in b.columns)):
                if key != last and held:
                    yield solve()
                    held.clear()
                last = key
                held.append((node, comp, fp, np.frombuffer(s, np.uint64)))
        if held:
            yield solve()
        held.clear()
        release_memory()

    rows = crowds.join(_sets(crowds, docs, words), ["hi", "lo"]).select("key", "node", "comp", *_FP, "s")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``a, b`` between the nodes of those pairs whose shingle sets have the similarity."""

    def compare(batches):
        head = None
        for b in batches:
            a_out, b_out = [], []
            for anode, bnode, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if bnode is None:
                    head = own.copy()
                    continue
                at = np.searchsorted(head, own)
                both = int((head[np.minimum(at, len(head) - 1)] == own).sum())
                if both >= similarity * (len(head) + len(own) - both) * (1 - 1e-12):
                    a_out.append(anode)
                    b_out.append(bnode)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        release_memory()

    known = _sets(pairs.selectExpr("anode node").union(pairs.selectExpr("bnode")), docs, words)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("bhi", "blo"), F.lit(PARTS)))
    heads = dealt.select("ahi", "alo", "part").distinct().join(known.toDF("ahi", "alo", "s"), ["ahi", "alo"]).selectExpr("ahi", "alo", "part", "null anode", "null bnode", "s")
    others = dealt.join(known.toDF("bhi", "blo", "s"), ["bhi", "blo"]).select("ahi", "alo", "part", "anode", "bnode", "s")
    rows = others.unionByName(heads).repartition("ahi", "alo", "part").sortWithinPartitions("ahi", "alo", "part", F.col("bnode").asc_nulls_first())
    return rows.select("anode", "bnode", "s").mapInArrow(compare, "a long, b long")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id``: the smallest id reachable over pairs whose sets of ``words``-word shingles have the Jaccard similarity.

    Texts with equal sets are one class and never paired; texts without words are such a class. Classes that share a band key, and whose
    fingerprints lie within :func:`proposal_radius`, are compared whole: first the pairs met as the BK-tree of a key is built, then, where
    the classes but the root still are of several components, the pairs that a search in a BK-tree of these finds. Rows with a null id are left out.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("text"))
    rows = checkpoint(_classes(texts, words))
    classes = checkpoint(rows.groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in _FP], F.first("keys").alias("keys")))
    pairs = checkpoint(_tree_pairs(classes.withColumn("comp", F.col("node")), similarity))
    links = checkpoint(_similar(pairs, texts, words, similarity))
    so_far = classes.join(connected_components(links), "node", "left").withColumn("comp", F.coalesce("label", "node"))
    crowds = checkpoint(_crowds(so_far))
    labels = connected_components(links.unionByName(_crowd_links(crowds, texts, words, similarity)))
    component = classes.join(labels, "node", "left").select("hi", "lo", F.coalesce("label", "node").alias("component_id"))
    return rows.join(component, ["hi", "lo"]).select(F.col("id").alias(id_col), "component_id")

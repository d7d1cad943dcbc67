"""Exact repeated-substring removal across documents by prefix-free parsing.

The text of each document is parsed at *triggers*: positions whose rolling hash over ``K`` bytes is the smallest of some
``LENGTH``-byte window. Whether a trigger is a window's smallest depends on the window alone, so every two equal windows have
the same trigger at the same place. The *phrase* of a trigger holds all windows it can be the trigger of (up to ``REACH`` bytes to the
left, ``LENGTH`` from its start to the right, within the document). The *dictionary* has each distinct phrase
once, with the smallest document it occurs in; the *parse* is each chunk's list of phrases. Highly repetitive text makes the dictionary
small, and only its phrases, not their copies, are sorted: each range of the dictionary gets the suffix array of its phrases, to a depth of
``LENGTH`` bytes. Suffixes of one rank are equal windows, and with the parse that decides every window of the corpus. An array of the
parse itself would order suffixes beyond the end of a phrase; windows never reach there.

Phrases count as copies if their 64-bit hashes and their triggers' agree; among a million variants of one trigger the chance that any two differ
all the same is 3e-8. Windows of different phrases are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake.llm._common import hold, release_memory, shuffle_partitions, utf8

LENGTH, K = 50, 20
REACH = LENGTH - K
#: Bytes of text in a chunk, about: the unit that is parsed in one piece, and the most of a dictionary range.
CHUNK = 4_000_000
#: Chunks whose dictionaries make up one range of the dictionary. The number of ranges follows the text, so that ranges keep their size;
#: a chunk sends one row for each range that it has phrases in, and so at most one for each of its phrases.
CHUNKS = 4
#: Bytes of text in a partition, about.
PARTITION = 64_000_000
SEGMENT = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPAN = SEGMENT + 512
_UP = np.r_[np.uint64(1), np.cumprod(np.full(_SPAN, _BASE, np.uint64))]
_DOWN = np.r_[np.uint64(1), np.cumprod(np.full(_SPAN, pow(_BASE, -1, 2**64), np.uint64))]


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    at = 1
    while 2 * at <= width:
        x = op(x[:-at], x[at:])
        at *= 2
    rest = width - at
    return op(x[: len(x) - rest], x[rest:]) if rest else x


class Parse:
    """Triggers of a chunk: place, phrase ``lo:hi``, document number, hash of trigger and of phrase."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        parts = [self._segment(data, ends, x, min(x + SEGMENT, len(data))) for x in range(0, len(data), SEGMENT)]
        self.at, self.lo, self.hi, self.doc, self.trigger, self.phrase = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)]

    @staticmethod
    def _segment(data, ends, x, y):
        a, b = max(0, x - 2 * LENGTH), min(len(data), y + 2 * LENGTH)
        part = data[a:b]
        n = len(part)
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        own = np.minimum(ends[first : last + 1], b) - np.maximum(np.r_[0, ends][first : last + 1], a)
        doc = np.repeat(np.arange(first, last + 1), own)
        none = np.zeros(0, np.int64)
        if n < LENGTH:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[part] * _DOWN[:n], out=total[1:])
        h = _mix((total[K:] - total[:-K]) * _UP[: n - K + 1])
        least = _slide(h, REACH + 1, np.minimum)
        least[doc[: n - LENGTH + 1] != doc[LENGTH - 1 :]] = 0  # windows over a document's end
        pad = np.zeros(REACH, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == h)
        at = at[(at >= x - a) & (at < y - a)]
        d = doc[at]
        lo = np.maximum(at - REACH, np.r_[0, ends][d] - a)
        hi = np.minimum(at + LENGTH, ends[d] - a)
        keep = hi - lo >= LENGTH
        at, d, lo, hi = at[keep], d[keep], lo[keep], hi[keep]
        text = (total[hi] - total[lo]) * _UP[lo]
        phrase = _mix(text + _mix(((at - lo) * 256 + (hi - at)).astype(np.uint64)))
        return at + a, lo + a, hi + a, d, h[at], phrase


def _pack(x: np.ndarray, width: int) -> bytes:
    """Integers as ``width`` byte planes, which compress well."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _runs(x: np.ndarray):
    """Each value of a sorted array, and where it is."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
    yield from zip(x[edge].tolist(), map(slice, edge.tolist(), [*edge[1:].tolist(), len(x)]))


class _Chunk:
    """A chunk's documents in a fixed order, its parse and its part of the dictionary, sorted by bucket."""

    def __init__(self, table: pa.Table, buckets: int, parse: bool = True):
        hold("substrings", None, object)
        release_memory()
        ids, texts = table.column("__id").to_pylist(), table.column("__text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([_NONE if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts])
        if not parse:
            return
        known = int((self.ids != _NONE).sum())  # rows without an id take no part
        ends = self.ends[:known]
        p = self.parse = Parse(self.data[: ends[-1] if known else 0], ends)
        by = np.argsort(p.phrase, kind="stable")  # stable: the smallest document comes first
        new = np.r_[True, p.phrase[by][1:] != p.phrase[by][:-1]] if len(by) else np.zeros(0, bool)
        first = by[new]
        bucket = (p.trigger[first] % np.uint64(buckets)).astype(np.int64)
        rank = np.argsort(bucket, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.entry = np.empty(len(by), np.int64)  # of each trigger
        self.entry[by] = place[np.cumsum(new) - 1]
        self.first, self.bucket = first[rank], bucket[rank]
        last = by[np.r_[np.flatnonzero(new)[1:], len(by)] - 1][rank] if len(by) else by
        self.least, self.several = self.ids[p.doc[self.first]], self.ids[p.doc[last]] != self.ids[p.doc[self.first]]


_SAID = "key long, chunk long, a binary, b binary, c binary, d binary"


def _rows(rows: list[tuple]) -> pa.Table:
    names = ["key", "chunk", "a", "b", "c", "d"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)


def _dictionary(chunk: _Chunk, number: int, buckets: int) -> pa.Table:
    p, rows = chunk.parse, []
    for b, s in _runs(chunk.bucket):
        f = chunk.first[s]
        rows.append((b, number, _pack(p.trigger[f] // np.uint64(buckets), 6), _pack(p.phrase[f], 8), _pack(chunk.least[s].view(np.uint64), 8), np.packbits(chunk.several[s]).tobytes()))
    return _rows(rows)


def _merge(table: pa.Table) -> pa.Table:
    """One range of the dictionary: the smallest document of each phrase, for the chunks that need to know."""
    release_memory()
    bucket, chunk = table.column("key")[0].as_py(), table.column("chunk").to_pylist()
    trigger = [_unpack(x, 6) for x in table.column("a").to_pylist()]
    size = np.array([len(x) for x in trigger])
    trigger = np.concatenate(trigger)
    phrase = np.concatenate([_unpack(x, 8) for x in table.column("b").to_pylist()])
    doc = np.concatenate([_unpack(x, 8) for x in table.column("c").to_pylist()]).view(np.int64)
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("d").to_pylist(), size)]).astype(bool)
    by = np.lexsort((doc, phrase, trigger))
    t, p, d = trigger[by], phrase[by], doc[by]
    new_t = np.r_[True, t[1:] != t[:-1]]
    new_p = new_t | np.r_[True, p[1:] != p[:-1]]
    at_t, at_p = np.flatnonzero(new_t), np.flatnonzero(new_p)
    of_t, of_p = np.cumsum(new_t) - 1, np.cumsum(new_p) - 1
    shared = np.maximum.reduceat(several[by], at_t) | (np.minimum.reduceat(d, at_t) != np.maximum.reduceat(d, at_t))
    variants = np.add.reduceat(new_p, at_t)
    least = d[at_p][of_p]  # sorted by document within a phrase
    compare = shared[of_t] & (variants[of_t] > 1) & (d == least)
    tell = compare | several[by] | (d > least)
    index = np.arange(len(trigger)) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(np.arange(len(size)), size)
    pick = by[tell]
    order = np.argsort(source[pick], kind="stable")
    pick, least, compare = pick[order], least[tell][order], compare[tell][order]
    cut = np.searchsorted(source[pick], np.arange(len(size) + 1))
    rows = []
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        if a < b:
            rows.append((bucket, chunk[k], _pack(index[pick[a:b]].astype(np.uint64), 4), _pack(least[a:b].view(np.uint64), 8), np.packbits(compare[a:b]).tobytes(), None))
    return _rows(rows)


def _cover(length: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    inside = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, inside]))
    return turn[::2], turn[1::2]


def _resolve(chunk: _Chunk, number: int, said: pa.Table, buckets: int) -> pa.Table:
    """Spans that are known to go, kept with the chunk, and the first occurrences of phrases that are to be compared."""
    p = chunk.parse
    least, compare = np.full(len(chunk.first), _NONE), np.zeros(len(chunk.first), bool)
    keys = said.column("key").to_numpy()
    for start, index, docs, flags in zip(np.searchsorted(chunk.bucket, keys).tolist(), *(said.column(c).to_pylist() for c in ("a", "b", "c"))):
        i = start + _unpack(index, 4).astype(np.int64)
        least[i] = _unpack(docs, 8).view(np.int64)
        compare[i] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(i)).astype(bool)
    own = chunk.ids[p.doc]
    gone = least[chunk.entry] < own
    a, b = _cover(len(chunk.data), p.lo[gone], p.hi[gone])
    rows = [(-1 - number, number, _pack(a.astype(np.uint64), 8), _pack(b.astype(np.uint64), 8), None, None)]
    ask = np.flatnonzero(compare[chunk.entry] & ~gone)
    bucket = (p.trigger[ask] % np.uint64(buckets)).astype(np.int64)
    ask = ask[np.argsort(bucket, kind="stable")]
    bucket.sort()
    raw = chunk.data.tobytes()
    for b, s in _runs(bucket):
        i = ask[s]
        text = b"".join([raw[x:y] for x, y in zip(p.lo[i].tolist(), p.hi[i].tolist())])
        place = np.stack([p.at[i], p.at[i] - p.lo[i], p.hi[i] - p.at[i]]).astype("<i8").tobytes()
        rows.append((b, number, _pack(p.trigger[i], 8), _pack(own[i].view(np.uint64), 8), place, text))
    return _rows(rows)


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The suffix array's ranks to a depth of LENGTH bytes: equal for suffixes whose first LENGTH bytes are equal (or run into the end alike).

    By prefix doubling: ranks to depth 2 k come from pairs of ranks to depth k; LENGTH bytes are two overlapping runs of the last
    power of two. Bytes are compared, not hashes.
    """
    rank, depth, n = text.astype(np.int64) + 1, 1, len(text)

    def joined(step: int) -> np.ndarray:
        second = np.r_[rank[step:], np.zeros(min(step, n), np.int64)]
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1

    while 2 * depth <= LENGTH:
        rank = joined(depth)
        depth *= 2
    if depth < LENGTH:
        rank = joined(LENGTH - depth)
    return rank - 1


def _compare(table: pa.Table) -> pa.Table:
    """Phrases of one dictionary range, window by window; a span list just passes."""
    if table.column("key")[0].as_py() < 0:
        return table
    release_memory()
    cols = {c: table.column(c).to_pylist() for c in ("chunk", "a", "b", "c", "d")}
    trigger = np.concatenate([_unpack(x, 8) for x in cols["a"]])
    doc = np.concatenate([_unpack(x, 8) for x in cols["b"]]).view(np.int64)
    place = np.concatenate([np.frombuffer(x, "<i8").reshape(3, -1) for x in cols["c"]], axis=1)
    chunk = np.repeat(cols["chunk"], [len(x) // 24 for x in cols["c"]])
    text = np.frombuffer(b"".join(cols["d"]), np.uint8)
    at, left, right = place
    start = np.cumsum(left + right) - left - right
    by = np.argsort(trigger, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(trigger[by]) != 0])
    marks = np.zeros(len(at), np.uint32)
    begin = 0
    while begin < len(by):  # some thousand phrases at once, whole triggers
        k = np.searchsorted(bounds, begin + 10_000)
        end = bounds[k] if k < len(bounds) else len(by)
        i = by[begin:end]
        begin = end
        size = left[i] + right[i]
        first = np.cumsum(size) - size
        rank = suffix_ranks(text[np.repeat(start[i] - first, size) + np.arange(size.sum())])
        windows = size - LENGTH + 1  # suffixes that have LENGTH bytes within their phrase
        of = np.repeat(np.arange(len(i)), windows)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = rank[first[of] + offset]
        least = np.full(len(rank), _NONE)
        np.minimum.at(least, place, doc[i[of]])
        gone = np.flatnonzero(least[place] < doc[i[of]])
        where = REACH - left[i[of[gone]]] + offset[gone]
        np.bitwise_or.at(marks, i[of[gone]], np.uint32(1) << where.astype(np.uint32))
    rows = []
    hit = np.flatnonzero(marks)
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    bucket = table.column("key")[0].as_py()
    for c in np.unique(chunk[hit]):
        i = hit[chunk[hit] == c]
        rows.append((bucket, int(c), _pack(at[i].astype(np.uint64), 8), _pack(marks[i].astype(np.uint64), 4), None, None))
    return _rows(rows)


def _finish(table: pa.Table, said: pa.Table, names: list[str], whole: bool) -> pa.Table:
    chunk = _Chunk(table, 1, parse=False)
    lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for key, a, b in zip(*(said.column(c).to_pylist() for c in ("key", "a", "b"))):
        x = _unpack(a, 8).astype(np.int64)
        if key < 0:
            lo.append(x)
            hi.append(_unpack(b, 8).astype(np.int64))
        else:
            marks = _unpack(b, 4)
            row, offset = np.nonzero((marks[:, None] >> np.arange(REACH + 1, dtype=np.uint64)) & np.uint64(1))
            lo.append(x[row] - REACH + offset)
            hi.append(lo[-1] + LENGTH)
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(edge, np.concatenate(lo), 1)
    np.add.at(edge, np.concatenate(hi), -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept, spans = [], []
    for end, text in zip(chunk.ends.tolist(), chunk.texts):
        mask = gone[end - len(text) : end]
        turn = np.flatnonzero(np.diff(np.r_[False, mask, False]))
        spans.append(turn.reshape(-1, 2).tolist())
        rest = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(turn) else text
        kept.append(rest.decode("utf-8", "ignore") if whole else rest)
    table = table.take(chunk.order)
    out = {names[-2]: pa.array(kept, pa.string() if whole else pa.binary()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64())))}
    return pa.table([out[n] if n in out else table.column(n) for n in names], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned_col: str | None = None) -> DataFrame:
    """``docs`` without ``text_col``, with ``kept`` (binary: the bytes that stay) and ``spans`` (removed runs, [begin, end)).

    With ``cleaned_col`` that column comes in place of ``kept``: the bytes that stay as a string, without what a cut inside a character
    has left of it. It may be ``text_col`` itself; any other column of that name is replaced.

    Removes each byte covered by a 50-byte string that also starts in a document with a smaller id, judged on the input. Texts are
    UTF-8 bytes, null is empty; texts shorter than 50 bytes stay whole. Matches never cross documents; rows with equal ids are one
    document in this respect. Rows with a null id are returned unchanged and match nothing.

    Text is shuffled once, by chunk (about 4 MB each), and stays there: what travels is each chunk's part of the dictionary
    (some 15 bytes for each distinct phrase; each chunk sends a phrase once, however often it has it), the answers, and the first
    occurrences of those phrases whose trigger has several. Columns called kept or spans are replaced. So a passage that a third of all documents share costs each range
    of the dictionary one entry for each chunk at most.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(8, -(-total // CHUNK))
    buckets = max(8, chunks // CHUNKS)
    rest = cleaned_col or "kept"
    kept = [c for c in docs.columns if c not in (text_col, rest, "spans")]
    parts = max(shuffle_partitions(docs.sparkSession), -(-total // PARTITION))
    base = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        utf8(F.col(text_col)).alias("__text"),
        F.col(id_col).cast("long").alias("__id"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(chunks)).alias("__chunk"),
    ).repartition(parts, "__chunk")
    number = lambda key: key[0].as_py()
    names = [*kept, rest, "spans"]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema, T.StructField(rest, T.StringType() if cleaned_col else T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def dictionary(key, table):
        return _dictionary(_Chunk(table, buckets), number(key), buckets)

    def resolve(key, table, said):
        return _resolve(_Chunk(table, buckets), number(key), said, buckets) if table.num_rows else _rows([])

    def finish(key, table, said):
        return _finish(table, said, names, cleaned_col is not None)

    entries = base.groupBy("__chunk").applyInArrow(dictionary, _SAID)
    answers = entries.repartition(parts, "key").groupBy("key").applyInArrow(_merge, _SAID).repartition(parts, "chunk")
    asked = base.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(resolve, _SAID).repartition(parts, "key")
    decided = asked.groupBy("key").applyInArrow(_compare, _SAID).repartition(parts, "chunk")
    return base.groupBy("__chunk").cogroup(decided.groupBy("chunk")).applyInArrow(finish, schema)

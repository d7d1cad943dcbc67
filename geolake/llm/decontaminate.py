"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake.llm._common import hold, utf8
from geolake.llm.bpe import small_batches

#: Bytes of item text in one automaton (some hundred megabytes in a worker), and of documents that several automata see in turn.
BLOCK, GATHER = 1_000_000, 64_000_000
#: Every byte outside the word pattern becomes a space, A-Z become lower case.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in bytes(range(256)).lower())
_WORD = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(WORD_BYTES).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of items, with the items of each window.

    A window is ``size`` consecutive words of an item, or the whole item if it is shorter (but not empty).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        add = self.vocabulary.setdefault
        coded = [(name, [add(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.step, self.link, self.longest = [{}], [-1], [0]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = min((min(len(ids), size) for _, ids in coded), default=size)
        pairs = set()
        for name, ids in coded:
            pairs.update(a * len(self.vocabulary) + b for a, b in zip(ids, ids[1:]))
            state, width = 0, min(size, len(ids))
            for n, c in enumerate(ids, 1):
                state = self.step[state][c]
                if n >= width:
                    while self.longest[self.link[state]] >= width:
                        state = self.link[state]
                    if width == size:
                        self.items.setdefault(state, set()).add(name)
                    else:
                        self.short.setdefault(state, []).append((width, name))
        self.pairs = np.array(sorted(pairs), np.int64)

    def _state(self, longest: int, link: int, step: dict) -> int:
        self.step.append(step), self.link.append(link), self.longest.append(longest)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.longest[q] == self.longest[p] + 1:
            return q
        clone = self._state(self.longest[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c, self.step[last][c])
        new = self._state(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.step[p][c])
        return new

    def scan(self, ids: list[int]):
        """Stream words; yields (begin, end, longest match, items) for each place where a window ends."""
        step, link, longest, size = self.step, self.link, self.longest, self.size
        state = length = 0
        for i, c in enumerate(ids, 1):
            while state and c not in step[state]:
                state = link[state]
                length = longest[state]
            if c in step[state]:
                state, length = step[state][c], length + 1
            else:
                continue
            at = state
            if length >= size:
                while longest[link[at]] >= size:
                    at = link[at]
                yield i - size, i, length, self.items.get(at, ())
            if self.short:
                while at > 0:
                    for width, name in self.short.get(at, ()):
                        if width <= length:
                            yield i - width, i, length, (name,)
                    at = link[at]

    def match(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str], int]]:
        """Hit spans (in words), items and longest match of each text.

        Only runs of words whose neighbouring pairs all occur in items are streamed: no match leaves such a run.
        """
        get = self.vocabulary.get
        sizes = np.array([len(w) + 1 for w in texts])
        flat: list[int] = []
        for w in texts:
            flat += [get(x, -1) for x in w]
            flat.append(-1)
        ids = np.array(flat, np.int64)
        known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        both = np.flatnonzero(known)
        if len(self.pairs):
            pair = ids[both] * len(self.vocabulary) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known[both[self.pairs[at] != pair]] = False
        else:
            known[:] = False
        begins = np.flatnonzero((ids >= 0) & ~np.r_[False, known])
        ends = np.flatnonzero((ids >= 0) & ~np.r_[known, False]) + 1
        long = ends - begins >= self.least
        starts = np.cumsum(sizes) - sizes
        out = [([], set(), 0) for _ in texts]
        for a, b in zip(begins[long].tolist(), ends[long].tolist()):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            spans, names, best = out[k]
            for x, y, length, items in self.scan(flat[a:b]):
                x, y = x + a - int(starts[k]), y + a - int(starts[k])
                if spans and x <= spans[-1][1]:
                    x, y = min(x, spans[-1][0]), max(y, spans[-1][1])
                    spans.pop()
                spans.append((x, y))
                names.update(items)
                best = max(best, length)
            out[k] = (spans, names, best)
        return out


def _automaton(block: tuple, size: int) -> ItemAutomaton:
    return hold("automaton", (hash(block), size), lambda: ItemAutomaton([(name, words_of(text)) for name, text in block], size))


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """``text`` without the given spans of words, each with what stands between its words."""
    if not spans:
        return text
    words = list(_WORD.finditer(text.translate(WORD_BYTES)))
    at, out = 0, []
    for a, b in spans:
        out.append(text[at : words[a].start()])
        at = words[b - 1].end()
    return b"".join([*out, text[at:]])


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cleaned_col: str | None = None, max_coverage: float = 1.0) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (spans of words, [begin, end)), ``items`` (sorted strings) and ``longest_match``.

    A hit word lies in an occurrence of ``window`` consecutive words of an item, or of a whole shorter item. With
    ``cleaned_col``, that column has the text without the hit spans, or null where hit words are more than ``max_coverage`` of all.
    Items are read in blocks of about 1 MB of text, each a broadcast. One narrow step, with one Python worker a task, streams the documents
    against the automaton of the block; with several blocks it gathers about GATHER bytes of documents and takes the automata in turn,
    one at a time, so that memory holds one of them whatever the number of items. Null texts and null items have no words; items
    with the same id count as one. All columns of ``docs`` are kept (those with the new names are replaced).
    """
    new = ["n_words", "hits", "items", "longest_match"]
    kept = [c for c in docs.columns if c not in (*new, cleaned_col)]
    spark = docs.sparkSession
    blocks, block, size = [], [], 0
    for r in items.select(F.col(item_id).cast("string").alias("i"), utf8(F.col(item_text)).alias("t")).where("i is not null").toLocalIterator():
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
        if size > BLOCK:
            blocks.append(spark.sparkContext.broadcast(tuple(block)))
            block, size = [], 0
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(tuple(block)))
    names = [*kept, *new, *([cleaned_col] if cleaned_col else [])]

    def gathered(batches):
        if len(blocks) == 1:
            yield from ([b] for b in batches)
            return
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= GATHER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for group in gathered(small_batches(batches)):
            texts = [b.column(b.num_columns - 1).to_pylist() for b in group]
            words = [[words_of(t) for t in own] for own in texts] if len(blocks) == 1 else None
            rows = [[([], set(), 0)] * len(own) for own in texts]
            for block in blocks:
                automaton = _automaton(block.value, window)
                for k, own in enumerate(texts):
                    found = automaton.match(words[k] if words else [words_of(t) for t in own])
                    rows[k] = [([*h, *spans], items_ | names_, max(most, best)) for (h, items_, most), (spans, names_, best) in zip(rows[k], found)]
            for k, b in enumerate(group):
                counts = [len(w) for w in (words[k] if words else map(words_of, texts[k]))]
                hits = [_joined([list(x) for x in r[0]]) for r in rows[k]]
                cols = [*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(r[1]) for r in rows[k]], pa.list_(pa.string())), pa.array([r[2] for r in rows[k]], pa.int64())]
                if cleaned_col:
                    over = [sum(y - x for x, y in h) > max_coverage * n for h, n in zip(hits, counts)]
                    cols.append(pa.array([None if o else cut_spans(t, h).decode("utf-8", "ignore") for o, t, h in zip(over, texts[k], hits)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    own = [F.col(f"`{c}`") for c in kept]
    added = [F.lit(0).cast("long").alias("n_words"), F.array(F.array(F.lit(0).cast("long"))).alias("hits"), F.array(F.lit("")).alias("items"), F.lit(0).cast("long").alias("longest_match"), *([F.lit("").alias(cleaned_col)] if cleaned_col else [])]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.select(*own, *added).schema])
    return docs.select(*own, utf8(F.col(text_col)).alias("__text")).mapInArrow(run, schema)

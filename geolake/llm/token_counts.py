"""Token counts under a unigram model, computed over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.llm._common import hold
from geolake.llm.bpe import small_batches

#: Stands for the white space before a pre-token.
SPACE = "▁"
#: Added to a piece's rank in the log-probability it starts from, -ln(rank + OFFSET).
OFFSET = 3.0
#: Nats that a byte of a character outside the vocabulary costs beyond the rarest piece; it is one token.
BYTE_COST = 10.0
#: Pre-tokens that a task holds between batches, about.
MEMO = 150_000
#: Characters of words that are solved together.
DEEP = 256
#: Steps of an automaton that are kept, about.
STEPS = 1_000_000
#: The bits of a code point.
CODES = (1 << 21) - 1


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with log-probabilities by rank, a start for :func:`estimate_pieces`; control and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {name: -math.log(rank + OFFSET) for rank, name in enumerate(names)}


class PieceTrie:
    """The beginnings of pieces as the states of an automaton: a text's state is the longest end of it that begins a piece.

    A state has, shortest first, the pieces that end there: characters, log-probability, tokens, number. The first is that of the last
    character, or its UTF-8 bytes where it is no piece. States and steps between them are added as texts need them.
    """

    def __init__(self, pieces: dict[str, float]):
        self.names = list(pieces)
        self.floor = min(pieces.values(), default=0.0) - BYTE_COST
        self.pieces = {name: (p, number) for number, (name, p) in enumerate(pieces.items())}
        self.begins = {name[:k] for name in pieces for k in range(1, len(name) + 1)}
        self.texts, self.ends, self.number = [""], [()], {}
        self.steps: dict[int, int] = {}
        self.columns = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64, np.int64, np.int64)]

    def step(self, key: int) -> int:
        """The state behind a state and a character, which ``key`` holds in its upper and its last 21 bits."""
        c = chr(key & CODES)
        text = self.texts[key >> 21] + c
        while text and text not in self.begins:
            text = text[1:]
        n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        state = self.number.setdefault(text or n, len(self.texts))
        if state == len(self.texts):
            own = [(k, *self.pieces[text[-k:]]) for k in range(1, len(text) + 1) if text[-k:] in self.pieces]
            bytes_ = [] if own and own[0][0] == 1 else [(1, n * self.floor, n, -1)]
            self.texts.append(text)
            self.ends.append((*bytes_, *((k, p, 1, number) for k, p, number in own)))
        if len(self.steps) > STEPS:  # a memo, no more
            self.steps.clear()
        self.steps[key] = state
        return state

    def _columns(self) -> list[np.ndarray]:
        """The ends of all states as columns, a row without characters behind each state's, and where each state's begin."""
        new = self.ends[len(self.columns[-1]) :]
        if new:
            rows = [row for own in new for row in (*own, (0, 0.0, 0, -1))]
            begin = np.cumsum([len(self.columns[0]), *(len(own) + 1 for own in new[:-1])])
            self.columns = [np.concatenate((c, np.array(v, c.dtype))) for c, v in zip(self.columns, (*zip(*rows), begin))]
        return self.columns

    def solve(self, words: list[str], used: np.ndarray | None = None, times: list[int] | None = None) -> dict[str, int]:
        """Tokens of each distinct word in its likeliest segmentation (of equally likely ones, that with fewer tokens).

        The words make up a trie, laid out level by level: a node is a parent and a character. All nodes of a level get their forward scores at
        once, from the scores of the nodes on the paths to them and the pieces that end there; the count at a terminal is the word's
        result. A character in no piece costs its UTF-8 bytes. ``used`` adds up how often each piece is used, ``times``
        being the occurrences of the words: they go back along the last tokens, from the deepest level on. Words beyond ``DEEP``
        characters are taken one by one.
        """
        weights = np.ones(len(words), np.int64) if times is None else np.array(times, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tokens, zero = np.zeros(len(words), np.int64), np.zeros(1, np.int64)
        for i in np.flatnonzero(sizes > DEEP).tolist():
            tokens[i] = self._alone(words[i], used, int(weights[i]))
        at = np.flatnonzero(sizes <= DEEP)  # the words that go on, and the nodes they are at
        node = np.zeros(len(at), np.int64)
        text = "".join(words if len(at) == len(words) else [words[i] for i in at.tolist()])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        start = np.zeros(len(words), np.int64)
        start[at] = np.cumsum(sizes[at]) - sizes[at]
        # of the nodes of each level: score, minus the number of tokens, state, parent, row of the last token, node where it begins
        levels = [(np.zeros(1), zero, zero, zero, zero, zero)]
        ended = [(zero[:0], zero[:0])]  # the nodes where words end, and these words
        while True:
            depth = len(levels)
            more = sizes[at] >= depth
            at, node = at[more], node[more]
            if not len(at):
                break
            nodes, node = np.unique(node << 21 | codes[start[at] + depth - 1], return_inverse=True)
            levels.append(self._level(levels, nodes >> 21, nodes & CODES))
            last = sizes[at] == depth
            ended.append((node[last], at[last]))
            tokens[at[last]] = -levels[-1][1][node[last]]
        if used is not None:
            self._use(levels, ended, weights, used)
        return dict(zip(words, tokens.tolist()))

    def _level(self, levels: list[tuple], parent: np.ndarray, code: np.ndarray) -> tuple:
        """The next level: nodes with these parents and characters."""
        keys, where = np.unique(levels[-1][2][parent] << 21 | code, return_inverse=True)
        found = [self.steps.get(key) for key in keys.tolist()]
        state = np.array([self.step(key) if s is None else s for s, key in zip(found, keys.tolist())], np.int64)[where]
        length, p, cost, _, begin = self._columns()
        row = begin[state]
        top, fewest, last, since = levels[-1][0][parent] + p[row], levels[-1][1][parent] - cost[row], row.copy(), parent.copy()
        row = row + 1
        live = np.flatnonzero(length[row])
        row, node, k = row[live], parent[live], 1
        while len(live):
            node = levels[-k][3][node]
            k += 1
            hit = np.flatnonzero(length[row] == k)
            if not len(hit):
                continue
            at, begins, piece = live[hit], node[hit], row[hit]
            score, minus = levels[-k][0][begins] + p[piece], levels[-k][1][begins] - 1
            best = (score > top[at]) | ((score == top[at]) & (minus > fewest[at]))
            at = at[best]
            top[at], fewest[at], last[at], since[at] = score[best], minus[best], piece[best], begins[best]
            row[hit] += 1
            more = length[row] > 0
            live, row, node = live[more], row[more], node[more]
        return top, fewest, state, parent, last, since

    def _use(self, levels: list[tuple], ended: list[tuple], weights: np.ndarray, used: np.ndarray) -> None:
        """Add the pieces of all words' segmentations to ``used``."""
        length, _, _, number, _ = self._columns()
        through = [np.zeros(len(level[0]), np.int64) for level in levels]
        for depth in range(len(levels) - 1, 0, -1):
            nodes, own = ended[depth]
            np.add.at(through[depth], nodes, weights[own])
            some = np.flatnonzero(through[depth])
            n, last, since = through[depth][some], levels[depth][4][some], levels[depth][5][some]
            piece = number[last]
            np.add.at(used, piece[piece >= 0], n[piece >= 0])
            for k in np.unique(length[last]).tolist():
                own = length[last] == k
                np.add.at(through[depth - k], since[own], n[own])

    def _alone(self, word: str, used: np.ndarray | None, n: int) -> int:
        """Tokens of one word."""
        state, scores, minus, last = 0, [0.0], [0], []
        for c in word:
            key = state << 21 | ord(c)
            state = self.steps.get(key)
            if state is None:
                state = self.step(key)
            top, row = -math.inf, None
            for end in self.ends[state]:
                p = end[1] + scores[-end[0]]
                if row is None or p > top or (p == top and minus[-end[0]] - end[2] > minus[-row[0]] - row[2]):
                    top, row = p, end
            fewest = minus[-row[0]] - row[2]
            scores.append(top)
            minus.append(fewest)
            last.append(row)
        at = len(word) if used is not None else 0
        while at:
            k, _, _, piece = last[at - 1]
            at -= k
            if piece >= 0:
                used[piece] += n
        return -minus[-1]


def trie_counts(words: list[str], pieces: dict[str, float]) -> dict[str, int]:
    """:meth:`PieceTrie.solve` under some pieces."""
    return PieceTrie(pieces).solve(list(dict.fromkeys(words)))


def _pretokens(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct pre-tokens of some texts, and the texts as their numbers."""
    number: dict[str, int] = {}
    add = number.setdefault
    own = [np.array([add(w, len(number)) for w in t.split()], np.int64) for t in texts]
    return [SPACE + w for w in number], own


def estimate_pieces(docs: DataFrame, pieces: dict[str, float], text_col: str = "text") -> dict[str, float]:
    """Log-probabilities of the pieces from their counts in the likeliest segmentations of all documents under ``pieces``.

    One step of expectation maximisation with the best segmentation in place of all, and one added to each count. The driver gets one
    count for each piece of the vocabulary, whatever the corpus. Without any token ``pieces`` stay as they are.
    """
    start, key = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def run(batches):
        trie = hold("pieces", key, lambda: PieceTrie(start.value))
        used = np.zeros(len(trie.names), np.int64)
        times: dict[str, int] = {}
        for b in small_batches(batches):
            words, own = _pretokens(b.column(0).to_pylist())
            each = np.bincount(np.concatenate(own), minlength=len(words)).tolist() if words else []
            for w, n in zip(words, each):
                times[w] = times.get(w, 0) + n
            if len(times) > MEMO:
                trie.solve(list(times), used, list(times.values()))
                times.clear()
        trie.solve(list(times), used, list(times.values()))
        some = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], names=["piece", "n"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    n = np.ones(len(pieces))
    n[found.column("piece").to_numpy()] += found.column("n").to_numpy()
    if not found.num_rows:
        return pieces
    return dict(zip(pieces, np.log(n / n.sum()).tolist()))


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", estimate: bool = True) -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens`` of each whole text.

    Pre-tokens are the runs between white space, each with a mark for the space before it. The pieces' probabilities are estimated from the
    documents (:func:`estimate_pieces`; one more pass) or, without ``estimate``, taken from their ranks. Each batch of a few megabytes puts its
    distinct new pre-tokens into one trie, whose terminal counts are then added up by document: narrow, without a shuffle. Null and
    empty texts have none. All columns are kept; those with the new names are replaced.
    """
    pieces = load_pieces(model_path)  # a published vocabulary, whatever the corpus
    if estimate:
        pieces = estimate_pieces(docs, pieces, text_col)
    shared, key = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex
    new = ["n_pretokens", "n_tokens"]
    kept = [c for c in docs.columns if c not in new]

    def run(batches):
        trie = hold("pieces", key, lambda: PieceTrie(shared.value))
        known: dict[str, int] = {}
        for b in small_batches(batches):
            words, own = _pretokens(b.column(b.num_columns - 1).to_pylist())
            known |= trie.solve([w for w in words if w not in known])
            each = np.array([known[w] for w in words], np.int64)
            if len(known) > MEMO:
                known.clear()
            total = [int(each[ids].sum()) for ids in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(ids) for ids in own], pa.int64()), pa.array(total, pa.int64())], names=[*kept, *new])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_pretokens"), F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(run, schema)

"""Toxicity by class-conditional Kneser-Ney models of words and expressions.

Three levels, each interpolated with the next by absolute discounting:

* *expressions*, pairs of neighbouring words, by class;
* *words*, by class;
* the *bytes* of words, n-grams up to ORDER with Kneser-Ney counts (in how many distinct words, behind how many distinct bytes), shared by
  both classes: what is rare or new to both is as likely in either.

An entry whose counts in the two classes differ by no more than chance (G squared below EVIDENCE) is pruned: its share goes to the
level below, so that the model stays normalised, in the cluster, before anything is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolake.llm._common import checkpoint, hold, utf8
from geolake.llm.bpe import small_batches
from geolake.llm.decontaminate import WORD_BYTES

#: Bytes of context plus one in the longest n-grams.
ORDER = 4
#: Words whose n-grams are in a worker's memory at once.
WORDS = 20_000
#: What a difference between the classes has to exceed (the 5 % point of one degree of freedom).
EVIDENCE = 3.84
#: Words seen less often are no evidence; expressions are pairs of words seen as often side by side in toxic texts, and more often than
#: two words of their frequencies would be by chance (G squared, the 0.1 % point).
WORD_COUNT, PAIR_COUNT, COLLOCATION = 2, 3, 10.83
#: An expression would have to be seen sqrt(toxic words) / PAIR_SCALE times: none, whatever the amount of text.
PAIR_SCALE = math.inf
#: Words whose log-likelihood ratios decide a document beside its average.
TOP = 3
#: Of crc32(id as text) mod 4: never seen; used to calibrate scores (and counted after that).
HELD_OUT, CALIBRATE = 2, 3
#: Counts by class, of the rows that do not calibrate and of those that do.
_COUNTS = ["ordinary", "toxic", "ordinary_c", "toxic_c"]
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; other characters than letters, digits and all beyond ASCII part them."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(WORD_BYTES).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64 of the binary value."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def _numbered(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of some texts, and the texts as numbers of words."""
    number: dict[bytes, int] = {}
    add = number.setdefault
    own = [np.array([add(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    return list(number), own


def grams(words: list[bytes]):
    """For each byte of each word (with marks around it) the word's number and, by order, whether the n-gram lies in
    the word and the n-gram itself: its bytes as one number, the last one lowest."""
    flat = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.int64)
    size = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(offset > 0)
    out, key = [], flat
    for n in range(1, ORDER + 1):
        if n > 1:
            key = key.copy()
            key[n - 1 :] |= flat[: 1 - n] << (8 * (n - 1))
        out.append((offset[at] >= n - 1, key[at]))
    return word[at], out


def _kind(b: pa.RecordBatch) -> np.ndarray:
    """The column of _COUNTS that a row adds to."""
    return (2 * (b.column(1).to_numpy() == CALIBRATE) + b.column(0).to_numpy()).astype(np.int64)


def _arrays(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _word_counts(batches):
    """word and counts: pre-aggregated by batch."""
    hold("toxicity", None, object)
    for b in small_batches(batches):
        names, own = _numbered(b.column(2).to_pylist())
        counts = np.zeros((4, len(names)), np.int64)
        for k, ids in zip(_kind(b).tolist(), own):
            counts[k] += np.bincount(ids, minlength=len(names))
        yield _arrays(["word", *_COUNTS], pa.array(names, pa.binary()), *counts)


def _gram_counts(batches):
    """gram and the number of words that have it: bytes are never zero, so that the number tells the order, too."""
    for b in batches:
        for s in range(0, b.num_rows, WORDS):
            _, by_order = grams(b.column(0).slice(s, WORDS).to_pylist())
            for inside, gram in by_order:
                found, n = np.unique(gram[inside], return_counts=True)
                yield _arrays(["gram", "n"], found, n)


def _pairs(names: list[bytes], own: list[np.ndarray]):
    """Of each text the hashes of its words, and the keys of its pairs of neighbouring words."""
    h = hash_words(names) if names else np.zeros(0, np.int64)
    for ids in own:
        w = h[ids]
        yield w, pair_keys(w[:-1], w[1:])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = (first.view(np.uint64) * _MUL + _ADD) ^ second.view(np.uint64)
    return ((key ^ (key >> np.uint64(29))) * _MUL).view(np.int64)


def _toxic_pairs(batches):
    """a, b, n: the pairs of toxic texts by the hashes of their words, pre-aggregated by batch."""
    for b in small_batches(batches):
        w, keys = zip(*_pairs(*_numbered(b.column(2).to_pylist())))
        first, second = (np.concatenate([x[s] for x in w]) for s in (slice(None, -1), slice(1, None)))
        _, at, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        yield _arrays(["a", "b", "n"], first[at], second[at], n)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` are in the sorted ``keys``; len(keys) for those that are not."""
    at = np.searchsorted(keys, wanted)
    if len(keys):
        at[keys[np.minimum(at, len(keys) - 1)] != wanted] = len(keys)
    return at


class ByteModel:
    """Interpolated Kneser-Ney model of the bytes of words."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """``grams``: distinct n-grams of all orders as numbers, sorted, and in how many words they occur."""
        edge = np.searchsorted(grams, [1 << (8 * n) for n in range(ORDER + 1)])
        edge[0] = 0
        #: By order the n-grams and their weights, then the contexts and theirs; a last entry for what is not there.
        self.levels = []
        for n in range(1, ORDER + 1):
            here = slice(edge[n - 1], edge[n])
            own, raw = grams[here], counts[here].astype(np.float64)
            contexts, context = np.unique(own >> 8, return_inverse=True)
            count = raw
            if n < ORDER:  # distinct bytes before, but where the word starts
                suffix = _find(own, grams[edge[n] : edge[n + 1]] & ((1 << (8 * n)) - 1))
                types = np.bincount(suffix, minlength=len(own) + 1)[: len(own)]
                count = np.where((own >> (8 * (n - 1)) == 2) & (n > 1), raw, types)
            d = discount((count == 1).sum(), (count == 2).sum())
            total = np.bincount(context, weights=count, minlength=len(contexts))
            kinds = np.bincount(context[count > 0], minlength=len(contexts))
            keep, back = np.zeros(len(own) + 1), np.ones(len(contexts) + 1)
            some = total > 0
            back[:-1][some] = (d * kinds / np.maximum(total, 1e-9))[some]
            keep[:-1] = np.maximum(count - d, 0) / np.maximum(total[context], 1e-9)
            self.levels.append((own, keep, contexts, back))

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of whole words, with their ends."""
        if not words:
            return np.zeros(0)
        word, by_order = grams(words)
        p = np.full(len(word), 1 / 256)
        for (own, keep, contexts, back), (inside, gram) in zip(self.levels, by_order):
            q = keep[_find(own, gram)] + back[_find(contexts, gram >> 8)] * p
            p = np.where(inside, q, p)
        return np.exp(np.maximum(np.bincount(word, weights=np.log(np.maximum(p, 1e-12)), minlength=len(words)), -600))


def discount(n1: float, n2: float) -> float:
    return min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)


def evidence(toxic, ordinary, toxic_total: float, ordinary_total: float):
    """G squared of two counts against equal rates; of numbers, arrays or Columns."""
    column = isinstance(toxic, F.Column)
    whole = max(toxic_total + ordinary_total, 1.0)

    def part(count, total):
        expected = (toxic + ordinary) * (max(total, 1e-9) / whole)
        if column:
            return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-300)), 0.0)

    return 2 * (part(toxic, toxic_total) + part(ordinary, ordinary_total))


class Model:
    """Log-likelihood ratios of words, alone and behind another word."""

    def __init__(self, words: dict[bytes, tuple[float, float]], totals: tuple[float, float], discounts: tuple[float, float], base: dict[bytes, float], pairs: dict[tuple[int, int], tuple[float, float]], firsts: dict[int, tuple[float, float]], named: dict[int, bytes]):
        """``words``: counts (ordinary, toxic) of kept words, of ``totals`` tokens; ``base``: byte probabilities of words; ``pairs``: counts of kept pairs,
        by hashes; ``firsts``: tokens of their first words; ``named``: their second words."""
        left = [1.0 - sum(max(c[k] - discounts[k], 0) for c in words.values()) / totals[k] if totals[k] else 1.0 for k in (0, 1)]
        left = [max(x, 1e-9) for x in left]
        self.other = math.log(left[1] / left[0])

        def alone(word: bytes, k: int) -> float:
            c = words.get(word, (0, 0))[k]
            return (max(c - discounts[k], 0) / totals[k] if totals[k] else 0.0) + left[k] * base.get(word, 0.0)

        self.words = {w: math.log(max(alone(w, 1), 1e-300) / max(alone(w, 0), 1e-300)) for w in words}
        self.behind: dict[int, tuple[float, dict[int, float]]] = {}
        by_first: dict[int, list] = {}
        for (a, b), c in pairs.items():
            by_first.setdefault(a, []).append((b, c))
        for a, own in by_first.items():
            n = firsts.get(a, (0, 0))
            share = lambda c, k: max(c[k] - discounts[k], 0) / n[k] if n[k] else 0.0  # noqa: E731, B023
            rest = [max(1.0 - sum(share(c, k) for _, c in own), 1e-9) for k in (0, 1)]
            back = math.log(rest[1] / rest[0])
            here = {}
            for b, c in own:
                p = [share(c, k) + rest[k] * alone(named[b], k) for k in (0, 1)] if b in named else [1.0, 1.0]
                here[b] = math.log(max(p[1], 1e-300) / max(p[0], 1e-300))
            self.behind[a] = back, here
        self.firsts = np.array(sorted(self.behind), np.int64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Two length-normalised ratios of each text: nats a byte over all words, and nats a word over its TOP words."""
        names, own = _numbered(texts)
        get = self.words.get
        ratio = np.array([get(w, self.other) for w in names])
        size = np.array([len(w) + 1 for w in names])
        h = hash_words(names) if names and len(self.firsts) else None
        out = np.zeros((len(texts), 2))
        for i, ids in enumerate(own):
            if not len(ids):
                continue
            r = ratio[ids]
            if h is not None:
                for j in np.flatnonzero(_find(self.firsts, h[ids[:-1]]) < len(self.firsts)).tolist():
                    back, here = self.behind[int(h[ids[j]])]
                    second = int(h[ids[j + 1]])
                    r[j + 1] = here[second] if second in here else r[j + 1] + back
            top = np.sort(r)[-TOP:]
            out[i] = r.sum() / size[ids].sum(), top.sum() / TOP
        return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def train(labelled: DataFrame) -> tuple[object, np.ndarray]:
    """A broadcast model and the weights of its calibration, from ``toxic`` (0, 1), ``part`` (crc32 of the id mod 4) and ``__text`` (binary).

    A first model, of the rows outside CALIBRATE, is calibrated on those within it, as sums over a grid of features; the model that scores
    counts both. The driver gets the words and expressions with evidence, which grow with the labelled texts, and the byte n-grams of words.
    """
    spark = labelled.sparkSession
    use = labelled.select(F.col("toxic").cast("long"), F.col("part").cast("long"), "__text")
    counted = ", ".join(f"{c} long" for c in _COUNTS)
    words = checkpoint(_sums(use.mapInArrow(_word_counts, f"word binary, {counted}"), "word"))
    first, last = (F.col("ordinary"), F.col("toxic")), (F.col("ordinary") + F.col("ordinary_c"), F.col("toxic") + F.col("toxic_c"))
    ask = [f(c == n).alias(f"s{i}{k}{n}") for i, p in enumerate((first, last)) for k, c in enumerate(p) for f, n in ((F.count_if, 1), (F.count_if, 2))]
    ask += [F.coalesce(F.sum(c), F.lit(0)).alias(f"t{i}{k}") for i, p in enumerate((first, last)) for k, c in enumerate(p)]
    s = words.agg(*ask).first()
    totals = [(float(s[f"t{i}0"]), float(s[f"t{i}1"])) for i in (0, 1)]
    discounts = [tuple(discount(s[f"s{i}{k}1"], s[f"s{i}{k}2"]) for k in (0, 1)) for i in (0, 1)]
    telling = lambda i, p: (p[0] + p[1] >= WORD_COUNT) & (evidence(p[1], p[0], totals[i][1], totals[i][0]) >= EVIDENCE)
    kept = words.where(telling(0, first) | telling(1, last)).toArrow().to_pydict()
    sums = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    bytes_model = ByteModel(sums.column("gram").to_numpy(), sums.column("n").to_numpy())

    often = use.where("toxic = 1").mapInArrow(_toxic_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= PAIR_COUNT)
    heard = words.select(F.xxhash64("word").alias("h"), (F.col("toxic") + F.col("toxic_c")).cast("double").alias("c")).where(F.col("c") >= PAIR_COUNT)
    often = often.join(heard.toDF("a", "ca"), "a").join(heard.toDF("b", "cb"), "b")
    chance = F.col("ca") * F.col("cb") / max(totals[1][1], 1.0)
    bound = (F.col("n") > chance) & (2 * (F.col("n") * F.log(F.col("n") / chance) - F.col("n") + chance) >= COLLOCATION)
    joined = often.where(bound).select("a", "b").toArrow()
    heads, tails = joined.column("a").to_numpy(), joined.column("b").to_numpy()
    keys = pair_keys(heads, tails)
    order = np.argsort(keys)
    heads, tails = heads[order], tails[order]
    candidates = spark.sparkContext.broadcast(keys[order])

    def pair_counts(batches):
        """Counts by the candidate's place, one row for each that a task has seen."""
        wanted = candidates.value
        counts = np.zeros((4, len(wanted)), np.int64)
        for b in small_batches(batches):
            for k, (_, keys) in zip(_kind(b).tolist(), _pairs(*_numbered(b.column(2).to_pylist()))):
                at = _find(wanted, keys)
                np.add.at(counts[k], at[at < len(wanted)], 1)
        at = np.flatnonzero(counts.any(axis=0))
        for s in range(0, len(at), 100_000):
            yield _arrays(["at", *_COUNTS], at[s : s + 100_000], *counts[:, at[s : s + 100_000]])

    pairs = _sums(use.mapInArrow(pair_counts, f"at long, {counted}"), "at")
    found = pairs.where(telling(0, first) | telling(1, last)).toArrow()
    at = found.column("at").to_numpy()
    found = {"a": heads[at].tolist(), "b": tails[at].tolist(), **{c: found.column(c).to_pylist() for c in _COUNTS}}
    ends = sorted({*found["a"], *found["b"]})
    known: dict[str, list] = {"word": [], **{c: [] for c in _COUNTS}}
    if ends:
        wanted = spark.createDataFrame([(x,) for x in ends], "h long")  # the kept pairs' own words
        known = words.withColumn("h", F.xxhash64("word")).join(F.broadcast(wanted), "h").drop("h").toArrow().to_pydict()
    spelled = dict(zip(hash_words(known["word"]).tolist(), known["word"])) if known["word"] else {}
    every = list({*kept["word"], *known["word"]})
    base = dict(zip(every, bytes_model.probabilities(every).tolist()))

    def model(i: int) -> Model:
        both = lambda d, j: (d["ordinary"][j] + i * d["ordinary_c"][j], d["toxic"][j] + i * d["toxic_c"][j])
        strong = lambda c: c[0] + c[1] >= WORD_COUNT and float(evidence(np.float64(c[1]), np.float64(c[0]), totals[i][1], totals[i][0])) >= EVIDENCE
        own = {w: c for j, w in enumerate(kept["word"]) if strong(c := both(kept, j))}
        two = {(a, b): c for j, (a, b) in enumerate(zip(found["a"], found["b"])) if strong(c := both(found, j))}
        firsts = {h: both(known, j) for j, h in enumerate(hash_words(known["word"]).tolist())} if known["word"] else {}
        return Model(own, totals[i], discounts[i], base, two, firsts, spelled)

    trial = spark.sparkContext.broadcast(model(0))

    def grid(batches):
        for b in small_batches(batches):
            f = trial.value.features(b.column(2).to_pylist())
            a, c = np.clip(np.round(f[:, 0] * 200), -400, 400), np.clip(np.round(f[:, 1] * 10), -400, 400)
            yield _arrays(["toxic", "a", "c"], b.column(0), a.astype(np.int64), c.astype(np.int64))

    cells = use.where(F.col("part") == CALIBRATE).mapInArrow(grid, "toxic long, a long, c long").groupBy("a", "c", "toxic").count().toArrow()
    cells = cells.sort_by([("a", "ascending"), ("c", "ascending"), ("toxic", "ascending")])  # sums in one order: the same scores each time
    final = spark.sparkContext.broadcast(model(1))
    if cells.num_rows == 0:
        return final, np.array([-1.0, 0.0, 1.0])
    a, c, y, n = (cells.column(k).to_numpy().astype(float) for k in ("a", "c", "toxic", "count"))
    return final, _fit(np.column_stack([a / 200, c / 10]), y, n)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from the rows of ``labels`` (``id_col``, ``toxic``) whose crc32(id as text) mod 4 is not 2; scores see the text only. The
    labelled texts are found by a join on the id; labels are broadcast up to a million rows and shuffled beyond that.
    An id with several labels counts as toxic if one says so; labels other than 0 and 1, and null ones, are left out. Scoring is
    narrow, with a model of the labelled texts' words. Null and empty texts get the score of a text without words. Without any usable label all
    scores come from an empty model. All columns are kept; those with the new names are replaced.
    """
    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    own = labels.where("toxic in (0, 1)").groupBy(id_col).agg(F.max("toxic").cast("long").alias("__toxic")).where((part != HELD_OUT) & F.col(id_col).isNotNull())
    if own.count() <= 1_000_000:
        own = F.broadcast(own)
    seen = docs.select(F.col(id_col), utf8(F.col(text_col)).alias("__text")).where(part != HELD_OUT).join(own, id_col)
    model, w = train(seen.select(F.col("__toxic").alias("toxic"), part.alias("part"), "__text"))
    new = ["held_out", "score", "predicted"]
    kept = [c for c in docs.columns if c not in new]

    def run(batches):
        hold("toxicity", None, object)
        for b in small_batches(batches):
            f = model.value.features(b.column(b.num_columns - 1).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], names=[*kept, "held_out", "score"])

    held = F.coalesce(part == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], held, utf8(F.col(text_col)).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], held, F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

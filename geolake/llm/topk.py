"""Exact top-k by inner product with pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolake.llm._common import checkpoint

#: Rows of a block of candidates and of a block of queries, about; the least rows for which candidates are dealt into more blocks to keep
#: all cores busy; pivots, and rows they are chosen from.
CANDIDATES, QUERIES, LEAST, PIVOTS, SAMPLE = 20_000, 20_000, 2_000, 56, 2_000
#: Candidates evaluated before the first threshold, then at a time.
FIRST, NEXT = 64, 1_024


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of a sample, each the farthest from the space that those before it span; fewer than ``n`` once nothing is left."""
    sample = sample[(np.abs(sample) < 1e100).all(1)]
    picked, rest = [], sample.copy()
    far = (rest**2).sum(1)
    least = 1e-6 * float(far.max(initial=0))
    while len(picked) < min(n, len(sample)) and far.max(initial=0) > least:
        i = int(far.argmax())
        picked.append(i)
        axis = rest[i] / np.sqrt(far[i])
        rest -= np.outer(rest @ axis, axis)
        far = (rest**2).sum(1)
    return sample[picked]


class PivotTable:
    """What the distances of vectors to the pivots say about them: the coordinates within the space that the pivots span, and the
    length of the part outside it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms = pivots, (pivots**2).sum(1)
        self.solve = np.linalg.inv(np.linalg.cholesky(pivots @ pivots.T)).T if len(pivots) else np.zeros((0, 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        norm = (x**2).sum(1)
        distance = norm[:, None] + self.norms - 2 * x @ self.pivots.T  # squared
        inside = ((norm[:, None] + self.norms - distance) / 2) @ self.solve
        return np.column_stack([inside, np.sqrt(np.maximum(norm - (inside**2).sum(1), 0))])


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, seen_of=None):
    """The ``k`` best candidates of one block for each query: (query row, candidate row, score).

    Distances to all pivots together bound the distance from below, d(q, c)^2 >= |q' - c'|^2 + (|q"| - |c"|)^2 with ' inside the pivots' space and
    " outside it, and so the inner product from above, q'.c' + |q"||c"|: one matrix product for all pairs. Candidates are evaluated in the order of
    that bound until it falls below the k-th score, so those with an equal score have all been seen. ``seen_of`` collects how many.
    """
    table = PivotTable(pivots)
    with np.errstate(over="ignore", invalid="ignore"):
        bounds_c, norm = table.rows(c), np.sqrt((c**2).sum(1))
    largest = float(np.sqrt(table.norms.max(initial=0)))
    exact = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1] < 2**52
    whole = (lambda x: x) if exact else (lambda x: np.array([[int(v) for v in row] for row in x], object))
    c, q_exact = whole(c), whole(q)
    rows = []
    for s in range(0, len(q), 32):
        part = q[s : s + 32]
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-7 * np.sqrt((part**2).sum(1))[:, None] * (norm + 1e-4 * largest) + 1e-3
            bound = table.rows(part) @ bounds_c.T + slack
        bound[np.isnan(bound)] = np.inf  # beyond the range of doubles: evaluated
        for i, b in enumerate(bound):
            b[cid == qid[s + i]] = -np.inf
            first = np.argpartition(-b, FIRST)[:FIRST] if len(b) > FIRST else np.arange(len(b))
            seen = first[b[first] > -np.inf]
            score = c[seen] @ q_exact[s + i]
            kth = lambda x: np.sort(x)[-k] if len(x) >= k else -np.inf
            least = kth(score)
            rest = b >= float(least)
            rest[first] = False
            rest &= b > -np.inf
            rest = np.flatnonzero(rest)
            rest = rest[np.argsort(-b[rest])]
            for a in range(0, len(rest), NEXT):
                if b[rest[a]] < float(least):
                    break
                more = rest[a : a + NEXT]
                seen, score = np.r_[seen, more], np.r_[score, c[more] @ q_exact[s + i]]
                least = kth(score)
            if seen_of is not None:
                seen_of.append(len(seen))
            best = sorted(range(len(seen)), key=lambda j: (-score[j], cid[seen[j]]))[:k] if not exact else np.lexsort((cid[seen], -score))[:k]
            rows += [(s + i, int(seen[j]), int(score[j])) for j in best]
    return rows


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: for each query the ``k`` rows with the largest inner product of floor(scale * x).

    ``is_query`` is a boolean column over ``vectors``; candidates are all rows but those with the query's own id; ties go to the smaller
    id. Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; shorter
    vectors count as padded with zeros; a repeated query row counts once. Queries and candidates are dealt into
    blocks of bounded size by a hash of the id; each pair of blocks is searched on its own, and a query keeps k rows of each block for the
    last ranking. So a candidate is shuffled once for every QUERIES queries and a query once for every CANDIDATES candidates. Pivots come
    from a bounded sample (they affect speed, never results). Components beyond 2^53 / scale are whole numbers already and count as they
    are, by exact integers; a score that does not fit 64 bits is an error.
    """
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    times = lambda v: v.cast("double") * scale
    whole = F.transform(x, lambda v: F.when(F.abs(times(v)) < 2.0**53, F.floor(times(v)).cast("double")).otherwise(times(v)))  # floor() ends at 2^63
    rows = checkpoint(vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")))
    n, n_queries, width = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.max(F.size("v"))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, q_blocks, width = max(1, -(-n // CANDIDATES), min(cores, n // LEAST)), max(1, -(-n_queries // QUERIES)), width or 1
    sample = rows.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("v").toArrow()
    pivots = vectors.sparkSession.sparkContext.broadcast(choose_pivots(_matrix(sample.column(0), width), PIVOTS))

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        qid, cid = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = search_block(qid, q, cid, c, pivots.value, k) if len(q) and len(c) else []
        return pa.table({"query_id": pa.array([int(qid[r[0]]) for r in found], pa.int64()), "id": pa.array([int(cid[r[1]]) for r in found], pa.int64()), "score": pa.array([r[2] for r in found], pa.int64())})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    home = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    queries = rows.where("q").select("id", "v").distinct().select("id", "v", home(q_blocks).alias("qb"), each(blocks).alias("cb"))
    candidates = rows.select("id", "v", home(blocks).alias("cb"), each(q_blocks).alias("qb"))
    found = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

"""Minimax contiguous sharding of atomic groups, with DataFrame operations only."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolake.llm._common import checkpoint

#: Hex digits of the group key in the first cells, and further digits for a cell that is looked into.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: At most so many cells are looked into at once; each gives at most 16 ** MORE_DIGITS rows to the driver.
MOST_CELLS = 512


def _walk(starts: list[int], whole: list[bool], total: int, capacity: int, n: int, hopeful: bool):
    """Greedy cuts. Known boundaries only, or, if hopeful, any point of a cell that holds several groups."""
    at, path = 0, []
    for _ in range(n):
        aim = at + capacity
        if aim >= total:
            return path, True
        i = bisect.bisect_right(starts, aim) - 1
        at = aim if hopeful and not whole[i] and starts[i] < aim else max(at, starts[i])
        path.append((i, at))
    return path, False


def _least(lo: int, hi: int, fits) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[list[str], int]:
    """Cut groups, in the order of their key, into ``n_shards`` runs whose largest total is as small as possible.

    ``groups`` has ``key`` (hex digits, evenly distributed, one row per atomic group) and ``bytes`` (long). Returns
    the first key prefix of each shard but shard 0, and the capacity. The binary search for the capacity runs on the driver
    over totals of key ranges, at most 4,096 at first. Only ranges in which a cut may fall are looked into, by a
    further aggregation, until the greedy check meets nothing but boundaries of single groups; so the
    capacity is exact however many groups there are, and the driver never holds more than a few ten thousand totals.
    """

    def cells(digits: int, inside: list[str] | None = None) -> list[tuple[str, int, int]]:
        of = groups if inside is None else groups.where(F.substring("key", 1, len(inside[0])).isin(inside))
        rows = of.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("c"), F.max("bytes").alias("m"))
        return [(r.p, r.b, r.c, r.m) for r in rows.collect()]

    found = sorted(cells(FIRST_DIGITS))
    if not found:
        return [], 0
    total, largest = sum(c[1] for c in found), max(c[3] for c in found)
    low = max(-(-total // n_shards), largest)
    while True:
        starts, at = [], 0
        for c in found:
            starts.append(at)
            at += c[1]
        whole = [c[2] == 1 for c in found]
        walk = lambda cap, hope: _walk(starts, whole, total, cap, n_shards, hope)
        capacity = low = _least(low, total, lambda cap: walk(cap, True)[1])
        hopeful, _ = walk(capacity, True)
        open_ = {i for i, at in hopeful if not whole[i] and at != starts[i]}
        if not open_:
            return [found[i][0] for i, at in hopeful if at < total], capacity
        sure, _ = walk(capacity, False)
        upper, _ = walk(_least(capacity, total, lambda cap: walk(cap, False)[1]), True)
        near = {j for (a, _), (b, _) in zip(sure, upper, strict=False) for j in range(a, b + 1) if not whole[j]}
        if len(near) <= MOST_CELLS:
            open_ |= near
        by_len: dict[int, list[str]] = {}
        for i in open_:
            by_len.setdefault(len(found[i][0]), []).append(found[i][0])
        finer = [c for k, inside in by_len.items() for c in cells(k + MORE_DIGITS, inside)]
        found = sorted([c for i, c in enumerate(found) if i not in open_] + finer)


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ``n_shards`` shards of nearly equal bytes; equal texts stay together.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``, one row per input row. Atomic groups are
    the equal texts (null counts as empty), ordered by the SHA-256 of the text; :func:`minimax_cuts` finds the
    smallest feasible capacity and the cuts, and a row's shard follows from its own key and the cuts, without a join.
    A group that is larger than a shard's share decides the capacity, as it cannot be divided. The slot
    is numbered within (shard, hash range of the id), with the ranges' counts added up on the driver
    (ids that are null or repeated are ordered by checksum and size), so that no task holds a whole shard.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.sha2(text, 256), 1, 32).alias("key"),
        )
    )
    groups = checkpoint(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts, _ = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    parts = max(8, min(4096, rows.count() // 250_000))
    dealt = rows.withColumns({"shard": shard.cast("int"), "part": F.pmod(F.xxhash64(id_col), F.lit(parts))})
    counts = sorted((r.shard, r.part, r["count"]) for r in dealt.groupBy("shard", "part").count().collect())
    before, at, last = [], 0, None
    for s, p, n in counts:
        at = at if s == last else 0
        before.append((s, p, at))
        at, last = at + n, s
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0, 0)], "shard int, part long, before long"))  # n_shards x 4,096 rows at most
    order = Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32", "size")
    return (
        dealt.withColumn("at", F.row_number().over(order))
        .join(offsets, ["shard", "part"])
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

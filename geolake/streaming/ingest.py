"""Structured Streaming into spatial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolake.operators.quadtree import point_code
from geolake.plans.api import GeoLake


def stream_points(lake: GeoLake, stream: DataFrame, database: str, table: str, x: str, y: str, checkpoint: str, indexed: bool = True, available_now: bool = True) -> StreamingQuery:
    """Append the points of a stream to a table, one snapshot for each micro-batch."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            (lake.write_with_index if indexed else lake.write)(database, table, batch, x=x, y=y)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_cell_counts(stream: DataFrame, time: str, x: str, y: str, window: str = "10 minutes", late: str = "10 minutes", depth: int = 4) -> DataFrame:
    """Points by time window and cell, with a watermark for late data."""
    coded = stream.withColumn("cell", point_code(x, y, depth)).withWatermark(time, late)
    return coded.groupBy(F.window(time, window).alias("window"), "cell").count()

"""Schemas and statistics from Parquet footers."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from geolake.shipping import ship_package

_STATS = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("rows", pa.int64()), ("min", pa.string()), ("max", pa.string()), ("nulls", pa.int64())])


def _open(uri: str) -> pq.ParquetFile:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return pq.ParquetFile(store.open_input_file(path))


def parquet_schema(uri: str) -> str:
    """The file's own schema as text."""
    return str(_open(uri).schema)


def parquet_stats(spark: SparkSession, uris: list[str]) -> DataFrame:
    """A row for each file, row group and column: rows, minimum, maximum (as text) and nulls. Footers are read by the executors, some files a task."""

    def run(batches):
        for b in batches:
            rows = []
            for uri in b.column(0).to_pylist():
                meta = _open(uri).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        column = meta.row_group(g).column(c)
                        s = column.statistics
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        rows.append((uri, g, column.path_in_schema, meta.row_group(g).num_rows, *bounds, s.null_count if s is not None and s.has_null_count else None))
            yield pa.RecordBatch.from_pylist([dict(zip(_STATS.names, r)) for r in rows], schema=_STATS)

    ship_package(spark)
    files = spark.createDataFrame([(u,) for u in uris], "file string").repartition(max(1, min(len(uris), 10_000)))
    return files.mapInArrow(run, "file string, row_group int, column string, rows long, min string, max string, nulls long")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.shipping import ship_package


_held: dict = {}


def hold(kind: str, key, make):
    """The one large helper object that a Python worker keeps between tasks; another one takes its place.

    Workers outlive stages, so helpers of operators that have run before would add up.
    """
    if _held.get("key") != (kind, key):
        if _held:
            _held.clear()
            release_memory()
        _held["value"] = make()
        _held["key"] = (kind, key)
    return _held["value"]


def release_memory() -> None:
    """Give memory that Python, Arrow and the C library hold in reserve back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, may leave it unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="geolake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage with a copy that survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> F.Column:
    """A text column as UTF-8 bytes, null as no bytes."""
    return F.coalesce(column, F.lit("")).cast("binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node, label`` for each node that has an edge to
    another; the label is the smallest node of its component. Each step is one aggregation and one join on the
    node, so a node with very many edges is pre-aggregated before the shuffle and its join is split by AQE. Edges stay
    in the cluster; each round is cut by a checkpoint and only a count and a checksum reach the driver. The number
    of rounds grows with the logarithm of the component size. Null ends and loops are ignored.
    """
    edges = checkpoint(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = checkpoint(large.distinct())  # every edge now goes from the larger to the smaller end
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

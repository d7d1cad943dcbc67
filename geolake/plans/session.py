"""Session factories."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geolake.shipping import ship_package

#: Settings that matter for spatial tables on any cluster: adaptive plans split large cells and merge small ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def make_session(master: str | None = None, app: str = "geolake", **conf) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``master`` only for local use, keywords are settings with __ for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = b.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    ship_package(spark)
    return spark


def make_local_session(cores: int = 4, driver_memory: str = "4g", **conf) -> SparkSession:
    """For one machine: few shuffle partitions, small splits, off-heap memory."""
    local = {"spark.sql.shuffle.partitions": str(2 * cores), "spark.sql.files.maxPartitionBytes": "32m", "spark.driver.memory": driver_memory, "spark.memory.offHeap.enabled": "true", "spark.memory.offHeap.size": "1g", "spark.ui.enabled": "false"}
    return make_session(f"local[{cores}]", **(local | conf))

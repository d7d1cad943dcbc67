"""The public facade: ingest files or DataFrames into spatial tables and look after their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS, encode_rows
from geolake.plans.sql import register_functions
from geolake.plans.table import GeoTable, TableSpec
from geolake.sources.readers import points_from_xy, read_geojson, read_spatial

INPUTS = ("geojson", "wkb", "wkt")


class GeoLake:
    """``input_format``: geojson, wkb or wkt. ``geometry_format``: wkb, sp, fsp or nfsp. Registers the SQL functions of the layout."""

    def __init__(self, spark: SparkSession, input_format: str = "wkb", geometry_format: str = "fsp", warehouse: str | None = None, on_error: str = "null", wkt_precision: str = "double", index_mode: str = "balanced"):
        if input_format not in INPUTS or geometry_format not in CODECS:
            raise ValueError(f"unknown format: {input_format}, {geometry_format}")
        self.spark, self.input, self.layout = spark, input_format, geometry_format
        self.codec = CODECS[geometry_format]
        self.warehouse = warehouse or spark.conf.get("spark.sql.warehouse.dir")
        self.on_error, self.precision, self.mode = on_error, wkt_precision, index_mode
        register_functions(spark, geometry_format)

    def table(self, database: str, table: str) -> GeoTable:
        return GeoTable(self.spark, TableSpec(database, table, self.warehouse), self.layout)

    def read(self, path: str) -> DataFrame:
        return read_geojson(self.spark, path, nested=self.layout == "nfsp") if self.input == "geojson" else read_spatial(self.spark, path)

    def encode(self, df: DataFrame) -> DataFrame:
        """``geometry`` (whatever the case of its name) as the table's layout; unreadable rows are left out."""
        name = next((c for c in df.columns if c.lower() == "geometry"), None)
        if name is None:
            raise ValueError("no column named geometry")
        df = df.withColumnRenamed(name, "geometry")
        if self.input == "geojson":
            if self.layout == "nfsp" and "geometries" in df.schema["geometry"].dataType.names:
                return df.where(F.col("geometry").isNotNull())
            return encode_rows(df, self.codec)
        return encode_rows(df, self.codec, source=self.input, on_error=self.on_error, precision=self.precision)

    def _rows(self, source, x: str | None, y: str | None, keep_columns: bool) -> DataFrame:
        if x is not None:
            df = source if isinstance(source, DataFrame) else read_spatial(self.spark, source)
            return points_from_xy(df, x, y, self.codec, keep_columns=keep_columns)
        return self.encode(source if isinstance(source, DataFrame) else self.read(source))

    def write(self, database: str, table: str, source, x: str | None = None, y: str | None = None, keep_columns: bool = False) -> GeoTable:
        """Append a DataFrame or a file, or the points of two of its columns, without an index."""
        t = self.table(database, table)
        t.append(self._rows(source, x, y, keep_columns))
        return t

    def write_with_index(self, database: str, table: str, source, driver_rows: int = Q.DRIVER_ROWS, max_partition_size: int = Q.MAX_ROWS, x: str | None = None, y: str | None = None, keep_columns: bool = False) -> GeoTable:
        """Append with cells from the table's quadtree, which grows by the new rows."""
        t = self.table(database, table)
        parsed = x is None and self.input != "geojson"
        t.append_indexed(self._rows(source, x, y, keep_columns), driver_rows, max_partition_size, self.mode, stage=parsed)
        return t

    def add_index_to_new_rows(self, database: str, table: str, driver_rows: int = Q.DRIVER_ROWS, max_partition_size: int = Q.MAX_ROWS) -> bool:
        return self.table(database, table).add_index_to_new_rows(driver_rows, max_partition_size, self.mode)

    def rebuild_index(self, database: str, table: str, driver_rows: int = Q.DRIVER_ROWS, max_partition_size: int = Q.MAX_ROWS) -> None:
        self.table(database, table).rebuild_index(driver_rows, max_partition_size, self.mode)

    def drop_index(self, database: str, table: str) -> None:
        self.table(database, table).drop_index()

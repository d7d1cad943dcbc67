"""Spatial tables: Parquet files partitioned by parts of the quadtree and sorted by cell, in snapshots.

A snapshot is a JSON file under ``_snapshots`` that names its data folders, layout, schema and tree; it appears whole, and each number
once, so readers see a snapshot with its index or none of it and no writer undoes another's. Data folders never change once written; each has a
manifest of its files, rows and cells under ``_manifests``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolake import schemas as S
from geolake.operators import quadtree as Q
from geolake.operators.codecs import CODECS
from geolake.shipping import ship_package

CODE = "region_code"
#: The partition column: an outer cell of many cells' rows, so that files follow the rows and not the cells. Folders without
#: ``parts`` in their entry are partitioned by the cell itself.
PART = "region_part"
#: Rows of a part that is not divided further, if its cells allow.
PART_ROWS = 500_000
#: Schemes whose rename is no single step.
OBJECT_STORES = ("s3a", "s3", "gs", "oss", "cosn")


@dataclass(frozen=True)
class TableSpec:
    database: str
    table: str
    warehouse: str

    @property
    def path(self) -> str:
        return f"{self.warehouse.rstrip('/')}/{self.database}/{self.table}"


class SchemaMismatch(ValueError):
    pass


class ConcurrentWrite(RuntimeError):
    """Another writer has replaced what an operation has read."""


class GeoTable:
    """One table. ``geometry`` holds the encoded geometry; ``region_code`` is the code of its cell, null if not indexed."""

    def __init__(self, spark: SparkSession, spec: TableSpec, layout: str = "fsp"):
        ship_package(spark)
        self.spark, self.spec = spark, spec
        self.path = spec.path
        self._read: dict[int, dict] = {}
        self._frames: dict[int, DataFrame] = {}
        self._parted_frames: dict[int, DataFrame] = {}
        last = self.snapshot()
        self.layout = last["layout"] if last else layout
        self.codec = CODECS[self.layout]

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _ids(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_snapshots")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self._ids())

    def snapshot(self, number: int | None = None) -> dict | None:
        if number is None:
            ids = self._ids()
            if not ids:
                return None
            number = ids[-1]
        if number not in self._read:  # snapshots never change
            fs, p = self._fs(f"{self.path}/_snapshots/{number:08d}.json")
            stream = fs.open(p)
            self._read[number] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self._read[number]

    def _publish(self, body: dict) -> bool:
        """Write a snapshot file, whole; false if another writer has published that number.

        A hard link on a local disk, a rename elsewhere (both fail where the name is taken), an exclusive create in
        object stores, where a file appears when it is closed.
        """
        fs, target = self._fs(f"{self.path}/_snapshots/{body['snapshot']:08d}.json")
        text, scheme = bytearray(json.dumps(body).encode()), fs.getUri().getScheme()
        try:
            if scheme in OBJECT_STORES:
                out = fs.create(target, False)
                out.write(text)
                out.close()
                return True
            _, temporary = self._fs(f"{self.path}/_snapshots/.{uuid.uuid4().hex}")
            out = fs.create(temporary)
            out.write(text)
            out.close()
            if scheme != "file":
                done = fs.rename(temporary, target)
                return done or bool(fs.delete(temporary, False)) and False
            try:
                local = lambda x: self.spark._jvm.java.io.File(x.toUri().getPath()).toPath()
                self.spark._jvm.java.nio.file.Files.createLink(local(target), local(temporary))
            finally:
                fs.delete(temporary, False)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def _commit(self, operation: str, base: dict | None, added: list[dict], replaced: list[dict], schema: str, tree: Q.Quadtree | None) -> None:
        """Publish the snapshot after ``base``: its folders without ``replaced``, and ``added``.

        A number is published once. If another writer has published it, the same change is made to that writer's snapshot, with the nodes of
        both trees (rows keep valid cells in either); an error if its schema differs or it lacks a folder that was to be replaced.
        """
        gone = {f["name"] for f in replaced}
        while True:
            folders = [f for f in (base["folders"] if base else []) if f["name"] not in gone]
            body = {"snapshot": base["snapshot"] + 1 if base else 1, "operation": operation, "layout": self.layout, "schema": schema, "folders": [*folders, *added], "tree": json.loads(tree.to_json()) if tree else None}
            if self._publish(body):
                return
            base = self.snapshot()
            if not gone <= {f["name"] for f in base["folders"]}:
                raise ConcurrentWrite(f"folders that {operation} has read are no longer in {self.path}")
            if operation == "drop_index" and any(f["indexed"] and f["name"] not in gone for f in base["folders"]):
                raise ConcurrentWrite(f"rows were indexed in {self.path} while the index was dropped")
            self._same_schema(base, schema)
            other = self._tree_of(base)
            if operation != "drop_index":
                tree = tree.merged(other) if tree and other else tree or other

    def _tree_of(self, last: dict | None) -> Q.Quadtree | None:
        return Q.Quadtree.from_json(json.dumps(last["tree"])) if last and last["tree"] else None

    def tree(self) -> Q.Quadtree | None:
        return self._tree_of(self.snapshot())

    def _schema(self, last: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(last["schema"]))

    def _scan(self, last: dict, folders: list[dict], part: bool = False) -> DataFrame:
        """All rows of some of a snapshot's folders, ``region_code`` last, or behind it their ``part``."""
        schema = T.StructType([*self._schema(last), T.StructField(CODE, T.LongType())])
        if not folders:
            rows = self.spark.createDataFrame([], T.StructType([*schema, T.StructField(PART, T.LongType())]))
            return rows if part else rows.drop(PART)
        names = [*schema.names, PART] if part else schema.names
        paths = lambda new: [f"{self.path}/data/{f['name']}" for f in folders if f.get("parts", False) is new]
        rows = None
        if paths(True):
            rows = self._parquet(T.StructType([*schema, T.StructField(PART, T.LongType())]), *paths(True)).select(names)
        if paths(False):
            by_cell = self._parquet(schema, *paths(False)).withColumn(PART, F.col(CODE)).select(names)
            rows = rows.unionByName(by_cell) if rows is not None else by_cell
        return rows

    def _cells(self, codes) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(pa.table({"__wanted": pa.array(codes, pa.int64())})))

    def _rows_of(self, last: dict, folders: list[dict], codes) -> DataFrame:
        """The rows of some cells, however many, from the partitions that hold them."""
        wanted = self._cells(codes)
        held = self.manifest(folders).join(wanted, F.col(CODE) == F.col("__wanted"), "left_semi")
        parts = [r[0] for r in held.select(F.coalesce(PART, CODE)).distinct().collect()]
        return self._scan(last, folders, True).where(F.col(PART).isin(parts)).join(wanted, F.col(CODE) == F.col("__wanted"), "left_semi").drop(PART)

    def _parquet(self, schema: T.StructType, *paths: str) -> DataFrame:
        """Data folders as a DataFrame; their cells' folders are listed by a few tasks instead of one each."""
        name, few = "spark.sql.sources.parallelPartitionDiscovery.parallelism", self._few()
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(min(int(before), few)))
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        finally:
            self.spark.conf.set(name, before)

    def _few(self) -> int:
        """Tasks for work of little cost by file."""
        return 4 * self.spark.sparkContext.defaultParallelism

    def df(self, number: int | None = None) -> DataFrame:
        """All rows of a snapshot (the last one if none is named), ``region_code`` last. Its files are listed once."""
        last = self.snapshot(number)
        if last is None:
            raise ValueError(f"no such table: {self.path}")
        if last["snapshot"] not in self._frames:
            self._frames = {last["snapshot"]: self._scan(last, last["folders"])}
        return self._frames[last["snapshot"]]

    def _write(self, rows: DataFrame, indexed: bool, tree: Q.Quadtree | None = None, gather: bool = True, order: tuple = ()) -> dict:
        """Rows into a new folder, by the parts of ``tree`` and sorted by cell, and its manifest.

        They are gathered by part, unless they are so already (or have :data:`PART`); REBALANCE lets AQE split parts that are too large for a task.
        """
        name = f"batch={uuid.uuid4().hex}"
        if PART not in rows.columns:
            rows = self._parted(rows, tree)
            rows = rows.hint("rebalance", PART) if gather else rows
        rows.sortWithinPartitions(PART, CODE, *order).write.partitionBy(PART).parquet(f"{self.path}/data/{name}")
        folder = {"name": name, "indexed": indexed, "parts": True}
        schema = T.StructType([T.StructField(CODE, T.LongType()), T.StructField(PART, T.LongType())])
        written = self._parquet(schema, f"{self.path}/data/{name}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), CODE, PART)
        files = written.coalesce(self._few()).groupBy("file", "bytes", CODE, PART).agg(F.count("*").alias("rows"))
        cell = Q.cell_struct(F.when(F.col(CODE) > 1, F.col(CODE)))
        files = files.select("file", "bytes", "rows", CODE, *[cell[c].alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], PART)
        files.coalesce(self._few()).write.parquet(self._manifest_path(folder))
        return folder

    def _parted(self, rows: DataFrame, tree: Q.Quadtree | None) -> DataFrame:
        """Add the part that a row's cell lies in; without a cell it has none."""
        if tree is None:
            return rows.withColumn(PART, F.col(CODE))
        codes, parts = (pa.array(v, pa.int64()) for v in zip(*tree.parts(PART_ROWS)))
        parts = self.spark.createDataFrame(pa.table({"__code": codes, "__part": parts}))
        rows = rows.join(F.broadcast(parts), F.col(CODE) == F.col("__code"), "left")
        return rows.withColumn(PART, F.coalesce("__part", CODE)).drop("__code", "__part")

    def _manifest_path(self, folder: dict) -> str:
        return f"{self.path}/_manifests/{folder['name'].split('=')[1]}"

    def manifest(self, folders: list[dict] | None = None) -> DataFrame:
        """``file, bytes, rows, region_code`` and the bounds of its cell (null without a cell, and for cell 1, which has none), ``region_part``: a row for each data file and cell."""
        if folders is None:
            last = self.snapshot()
            folders = last["folders"] if last else []
        kind = f"file string, bytes long, rows long, {CODE} long, min_x double, min_y double, max_x double, max_y double, {PART} long"
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[self._manifest_path(f) for f in folders])

    def _same_schema(self, last: dict, schema: str) -> None:
        plain = lambda s: T._parse_datatype_string(s.simpleString()).simpleString()
        own, rows = self._schema(last), T.StructType.fromJson(json.loads(schema))
        if plain(own) != plain(rows):
            raise SchemaMismatch(f"the table has {own.simpleString()}, the rows have {rows.simpleString()}")

    def _check(self, rows: DataFrame, last: dict | None) -> str:
        schema = T.StructType([f for f in rows.schema if f.name != CODE]).json()
        if last:
            self._same_schema(last, schema)
        return schema

    def append(self, rows: DataFrame) -> None:
        """Append encoded rows without an index."""
        last = self.snapshot()
        schema = self._check(rows, last)
        folder = self._write(rows.withColumn(CODE, F.lit(None).cast("long")), False)
        self._commit("append", last, [folder], [], schema, self._tree_of(last))

    def _indexed(self, rows: DataFrame, tree: Q.Quadtree) -> DataFrame:
        """Rows with their cells, gathered by part. Those without bounds (null and empty geometries) stay, with a cell of nulls."""
        names = [c for c in rows.columns if c != CODE]
        bounds = self.codec.bbox("geometry")
        coded = Q.assign(rows.select(*names, bounds.alias("__box")), F.col("__box"), tree, CODE).drop("__box")
        coded = self._parted(coded, tree).hint("rebalance", PART)  # before any bounds are added: less to shuffle
        coded = coded.join(F.broadcast(tree.bounds(self.spark)), F.col(CODE) == F.col("__code"), "left")
        outside, box = F.col(CODE) == 1, bounds
        own = F.struct(F.least(box["min_x"], F.lit(-180.0)).alias("min_x"), F.least(box["min_y"], F.lit(-90.0)).alias("min_y"), F.greatest(box["max_x"], F.lit(180.0)).alias("max_x"), F.greatest(box["max_y"], F.lit(90.0)).alias("max_y"), F.lit(1).cast("long").alias(CODE))
        none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in S.CELL])
        cell = F.when(outside, own).otherwise(F.coalesce(F.col("__cell"), none))
        return coded.withColumn("geometry", F.col("geometry").withField("bbox_partitioning", cell)).select(*names, CODE, PART)

    def _grown(self, rows: DataFrame, base: dict | None, driver_rows: int, max_rows: int, mode: str) -> Q.Quadtree:
        """The tree of ``base`` grown for further rows, with the rows it has counted along.

        Rows that are stored already are counted from the manifests. Those of leaves that may come to more than ``max_rows``, and
        of the leaves' outer cells, are read again to see into which children they would go: the leaves are the same whether rows come at once or
        bit by bit. All boxes count; only ``sequential`` and ``sampled`` trees grow from at most about ``driver_rows`` sampled ones.
        """
        bounds = self.codec.bbox("geometry")
        tree = self._tree_of(base) or Q.Quadtree.initial()
        indexed = [f for f in base["folders"] if f["indexed"]] if base else []
        stored = {r[CODE]: r["n"] for r in self.manifest(indexed).where(F.col(CODE).isNotNull()).groupBy(CODE).agg(F.sum("rows").alias("n")).toLocalIterator()}
        tree.counts = dict(stored)
        exact = mode == "balanced"
        boxed = lambda df: df.select(bounds.alias("__box"))
        counted = [Q.CountedBoxes(boxed(rows), F.col("__box"))] if exact else []
        new = Q.exact_boxes(counted, tree, driver_rows, max_rows)[0] if exact else Q.sample_boxes(boxed(rows), F.col("__box"), driver_rows)
        if mode == "sequential":
            tree.insert_all(new.paths, new.levels, max_rows, 1 / new.weight)
            return tree
        leaves = tree.crowded(new, max_rows)
        if not leaves:
            tree.grow([new], max_rows)
        else:
            codes = sorted({c >> 2 * k for c in leaves for k in range((c.bit_length() - 1) // 2 - Q.BASE_LEVEL + 1)})
            old = boxed(self._rows_of(base, indexed, codes))
            if exact:
                counted.append(Q.CountedBoxes(old, F.col("__box")))
                new, old = Q.exact_boxes(counted, tree, driver_rows, max_rows)
            else:
                old = Q.sample_boxes(old, F.col("__box"), driver_rows)
            tree.grow([new, old.within(tree, leaves)], max_rows)
        for c in counted:
            c.release()
        tree.counts = dict(stored)
        tree.add(new)
        return tree

    def append_indexed(self, rows: DataFrame, driver_rows: int = Q.DRIVER_ROWS, max_rows: int = Q.MAX_ROWS, mode: str = "balanced", stage: bool = False) -> None:
        """Append encoded rows with their cells; the tree grows first and is published with the rows.

        Counting, sampling and writing each read ``rows``. With ``stage`` they read a copy in the table's folder instead, so that rows which are dear
        to make (parsed in Python) are made once, and an executor lost later costs nothing but its own reads.
        """
        last = self.snapshot()
        schema = self._check(rows, last)
        if stage:
            copy = self._write(rows.withColumn(CODE, F.lit(None).cast("long")), False, gather=False)
            rows = self._scan({"schema": schema}, [copy]).drop(CODE)
        tree = self._grown(rows, last, driver_rows, max_rows, mode)
        folder = self._write(self._indexed(rows, tree), True)
        self._commit("append_indexed", last, [folder], [], schema, tree)
        if stage:
            self._delete([copy["name"]])

    def add_index_to_new_rows(self, driver_rows: int = Q.DRIVER_ROWS, max_rows: int = Q.MAX_ROWS, mode: str = "balanced") -> bool:
        """Give cells to the rows of the folders that have none; false if there are none. Rows without bounds keep a null cell."""
        last = self.snapshot()
        if last is None:
            raise ValueError(f"no such table: {self.path}")
        new = [f for f in last["folders"] if not f["indexed"]]
        if not new:
            return False
        rows = self._scan(last, new)
        tree = self._grown(rows, last, driver_rows, max_rows, mode)
        folder = self._write(self._indexed(rows, tree), True)
        self._commit("add_index", last, [folder], new, last["schema"], tree)
        return True

    def rebuild_index(self, driver_rows: int = Q.DRIVER_ROWS, max_rows: int = Q.MAX_ROWS, mode: str = "balanced") -> None:
        """A new tree for all rows, which are written anew."""
        last = self.snapshot()
        rows = self._scan(last, last["folders"])
        tree = self._grown(rows, None, driver_rows, max_rows, mode)
        folder = self._write(self._indexed(rows, tree), True)
        self._commit("rebuild_index", last, [folder], last["folders"], last["schema"], tree)

    def drop_index(self) -> None:
        """Forget the tree: indexed rows are written anew without cells."""
        last = self.snapshot()
        coded = [f for f in last["folders"] if f["indexed"]]
        rows = self._scan(last, coded)
        rows = rows.withColumns({"geometry": F.col("geometry").withField("bbox_partitioning", F.lit(None).cast(S.CELL)), CODE: F.lit(None).cast("long")})
        added = [self._write(rows, False)] if coded else []
        self._commit("drop_index", last, added, coded, last["schema"], None)

    def compact(self) -> None:
        """Gather the rows of the indexed folders, cell by cell, into one folder of fewer files."""
        last = self.snapshot()
        coded = [f for f in last["folders"] if f["indexed"]]
        tree = self._tree_of(last)
        folder = self._write(self._scan(last, coded), True, tree)
        self._commit("compact", last, [folder], coded, last["schema"], tree)

    def cluster(self, *order) -> None:
        """Rewrite all rows sorted along a key such as a numeric geohash, range by range."""
        last = self.snapshot()
        tree = self._tree_of(last)
        rows = self._scan(last, last["folders"]).repartitionByRange(*order)
        folder = self._write(rows, all(f["indexed"] for f in last["folders"]), tree, gather=False, order=order)
        self._commit("cluster", last, [folder], last["folders"], last["schema"], tree)

    def overwrite_cells(self, rows: DataFrame) -> None:
        """Replace the rows of every cell that ``rows`` (encoded, without cells) fall into; all other rows stay.

        Cells are those of the present tree, which does not grow. Folders that hold a replaced cell are written anew without it.
        """
        last = self.snapshot()
        tree = self._tree_of(last)
        if tree is None:
            raise ValueError(f"{self.path} has no index")
        schema = self._check(rows, last)
        folder = self._write(self._indexed(rows, tree), True)
        codes = [r[CODE] for r in self.manifest([folder]).where(F.col(CODE).isNotNull()).select(CODE).distinct().collect()]
        indexed = [f for f in last["folders"] if f["indexed"]]
        folder_of = F.regexp_extract("file", "/(batch=[0-9a-f]+)/", 1)
        wanted = self._cells(codes)
        held = self.manifest(indexed).join(wanted, F.col(CODE) == F.col("__wanted"), "left_semi")
        names = {r[0] for r in held.select(folder_of).distinct().collect()}
        met = [f for f in indexed if f["name"] in names]
        rest = self._scan(last, met).join(wanted, F.col(CODE) == F.col("__wanted"), "left_anti")  # no code: kept
        kept = [self._write(rest, True, tree, gather=not all(f.get("parts") for f in met))] if met else []
        self._commit("overwrite_cells", last, [*kept, folder], met, schema, tree)

    def snapshots(self) -> DataFrame:
        rows = [(s["snapshot"], s["operation"], len(s["folders"])) for s in (self.snapshot(i) for i in self._ids())]
        return self.spark.createDataFrame(rows, "snapshot long, operation string, folders int")

    def partitions(self) -> DataFrame:
        """Rows by cell, from the manifests."""
        return self.manifest().groupBy(CODE).agg(F.sum("rows").alias("count"))

    def files(self) -> DataFrame:
        return self.manifest().select("file", "bytes", "rows", CODE)

    def expire_snapshots(self, retain_last: int = 1) -> int:
        """Delete all but the last snapshots and the folders only they name; returns the number of folders."""
        ids = self._ids()
        keep = ids[-retain_last:]
        used = {f["name"] for i in keep for f in self.snapshot(i)["folders"]}
        for i in ids[: len(ids) - len(keep)]:
            fs, p = self._fs(f"{self.path}/_snapshots/{i:08d}.json")
            fs.delete(p, False)
        return self.delete_orphans(used)

    def _delete(self, names: list[str]) -> None:
        for name in names:
            for path in (f"{self.path}/data/{name}", self._manifest_path({"name": name})):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def delete_orphans(self, used: set[str] | None = None) -> int:
        """Delete data folders that no snapshot names, such as those of failed writes. Not while others write."""
        if used is None:
            used = {f["name"] for i in self._ids() for f in self.snapshot(i)["folders"]}
        fs, p = self._fs(f"{self.path}/data")
        gone = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName() not in used] if fs.exists(p) else []
        self._delete(gone)
        return len(gone)

    def window(self, x1: float, y1: float, x2: float, y2: float, outside: bool = False) -> DataFrame:
        """Rows that may meet a box (or, with ``outside``, lie beyond it), by partition; rows without a cell always may.

        The tree gives the codes, with all outer ones, so that they become a partition filter, too. The caller adds the exact predicate.
        """
        tree = self.tree()
        if tree is None:
            return self.df()
        codes = tree.cover_outside(x1, y1, x2, y2) if outside else tree.cover(x1, y1, x2, y2)
        last = self.snapshot()
        if last["snapshot"] not in self._parted_frames:
            self._parted_frames = {last["snapshot"]: self._scan(last, last["folders"], True)}
        rows = self._parted_frames[last["snapshot"]].where(F.col(PART).isin(codes) | F.col(PART).isNull())
        return rows.where(F.col(CODE).isin(codes) | F.col(CODE).isNull()).drop(PART)

    def decoded(self, rows: DataFrame | None = None, name: str = "geom") -> DataFrame:
        """Rows with the flat geometry in a further column."""
        return (self.df() if rows is None else rows).withColumn(name, self.codec.decode("geometry"))

    def create_view(self, name: str | None = None) -> None:
        self.df().createOrReplaceTempView(name or self.spec.table)

    def save_cells(self, path: str) -> None:
        """Write the tree's cells as Parquet."""
        self.tree().cells(self.spark).write.mode("overwrite").parquet(path)


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None, partition_by: list[str] | None = None) -> None:
    """A catalog table of Parquet files with a schema, partitioned or not; its database is made if need be."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name.split('.')[0]}`")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partition_by)})" if partition_by else ""
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{parts}{place}")


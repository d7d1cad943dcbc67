"""Length-delimited token records with masked checksums and a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.llm._common import shared_dir, shuffle_partitions
from geolake.llm.bpe import engine, load_spec, small_batches

#: The file format, version 1. Data file: MAGIC, then for each sequence its length (unsigned 64-bit), the masked CRC-32 of
#: these 8 bytes, the payload and its masked CRC-32. Payload: id (signed 64-bit), flags (1: id is null), bytes of
#: a token (2 or 4), two bytes of padding, tokens. Index file: MAGIC, then the offset of each record and its number of tokens
#: (unsigned 64-bit). All numbers are little-endian.
MAGIC = b"GLREC001"
MASK_DELTA = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits plus a constant, so that checksums of data that holds checksums stay sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join([head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))])


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    tokens = np.frombuffer(ids, "<u4")
    return struct.pack("<qBBxx", doc_id or 0, doc_id is None, width) + tokens.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=12).astype("<u4").tobytes()


def read_frame(f) -> bytes | None:
    """The next payload of an open file; an error where a checksum is wrong or the file ends inside a record."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError("a record's length is damaged")
    n = struct.unpack_from("<Q", head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack_from("<I", body, n)[0]:
        raise ValueError("a record is damaged")
    return body[:n]


def read_at(uri: str, number: int) -> tuple[int | None, bytes]:
    """Record ``number`` of a data file, by its index: two small reads wherever the record lies."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path + ".idx") as f:
        offset = struct.unpack("<QQ", f.read_at(16, len(MAGIC) + 16 * number))[0]
    with store.open_input_file(path) as f:
        f.seek(offset)
        return unpack(read_frame(f))


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> list[dict]:
    """Encode whole texts, in ascending order of ``id_col``, into record files under ``folder`` (a URI that executors share).

    Range partitions by id give one data file and one index file each, in order. A task writes under a name of its
    own attempt and only what a finished task reports enters the manifest, so lost executors and speculative copies leave
    at most unlisted files. Returns the manifest (one entry per file: part, uri, n_docs, n_tokens, start); the
    driver sees counts only. Null texts are empty; ``end_id`` is appended to each document. Null ids come first; rows with
    equal ids are ordered by their text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    spec = load_spec(spark, tokenizer_path)
    n = partitions or shuffle_partitions(spark)

    def run(batches):
        e = engine(spec.value)
        width = 2 if len(e.names) <= 65536 else 4
        tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        context = TaskContext.get()
        part = context.partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}.rec"
        data = index = None
        docs_, tokens = 0, 0
        try:
            for b in small_batches(batches):
                if data is None:
                    store.create_dir(base, recursive=True)
                    data, index = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20), store.open_output_stream(f"{base}/{name}.idx", buffer_size=1 << 16)
                    data.write(MAGIC), index.write(MAGIC)
                    at = len(MAGIC)
                for doc_id, ids in zip(b.column(0).to_pylist(), e.encode_many(b.column(1).to_pylist())):
                    ids += tail
                    record = frame(pack(doc_id, ids, width))
                    data.write(record)
                    index.write(struct.pack("<QQ", at, len(ids) // 4))
                    at += len(record)
                    docs_ += 1
                    tokens += len(ids) // 4
        finally:
            if data is not None:
                data.close(), index.close()
        if docs_:
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [f"{folder}/{name}"], "n_docs": [docs_], "n_tokens": [tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    files = sorted((r.asDict() for r in ordered.mapInArrow(run, "part long, uri string, n_docs long, n_tokens long").collect()), key=lambda r: r["part"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["n_tokens"]
    return files


def read_token_records(spark: SparkSession, files: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Read record files back: ``id_col, start, ids`` with ``start`` the tokens of all sequences before.

    One task for each file; every length and payload is checked.
    """

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                if k >= len(files):
                    continue
                store, path = fs.FileSystem.from_uri(files[k]["uri"])
                start, rows, size = files[k]["start"], [], 0

                def give(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=[id_col, "start", "ids"])

                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is not a record file")
                    while (payload := read_frame(f)) is not None:
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, start, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 4_000_000:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)

    n = max(1, len(files))
    return spark.range(0, n, 1, n).mapInArrow(run, f"{id_col} long, start long, ids binary")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

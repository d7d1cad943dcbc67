"""A corpus pipeline over the training-data operators: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``docs`` is what the
stage before has written; side tables (labels, benchmark) come from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.llm import _common as common
from geolake.llm.bpe import bpe_encode
from geolake.llm.decontaminate import find_leaks
from geolake.llm.queries import _tokenizer
from geolake.llm.similar import similar_documents
from geolake.llm.substring_dedup import remove_repeats
from geolake.llm.toxicity import score_toxicity

#: A document with a larger share of its words in benchmark windows goes as a whole.
MOST_LEAKED = 0.5
SIMILARITY, SHINGLE_WORDS = 0.8, 5


def _carried(docs: DataFrame) -> DataFrame:
    """The id, the text, and all other columns in ``__row``, where no operator replaces them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null"), *([F.struct(*rest).alias("rest")] if rest else [])).alias("__row"))


def _restored(rows: DataFrame, docs: DataFrame, text: F.Column | None = None) -> DataFrame:
    """The columns of ``docs``; with a new text, which n_chars follows."""
    out = {c: F.col(c) if c in ("doc_id", "text") else F.col("__row")["rest"][c] for c in docs.columns}
    if text is not None:
        out["text"] = text
        if "n_chars" in out:
            out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in out.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the others stay as they are."""
    return _restored(score_toxicity(_carried(docs), common.read_table(spark, sf_dir, "labels")).where("predicted = 0"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays.

    Near: a Jaccard similarity of 0.8 or more of the sets of five-word shingles, compared exactly. Rows without an id stay, and so do
    all rows that repeat an id that stays.
    """
    common.ship_package(spark)
    found = similar_documents(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILARITY).select(F.col("doc_id").alias("__id"), "component_id").distinct()
    first = found.where("component_id = __id").select("__id")
    kept = docs.join(first, F.col("doc_id") == F.col("__id"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that occur in a document with a smaller id are cut out; emptied documents go."""
    common.ship_package(spark)
    rows = remove_repeats(_carried(docs), cleaned_col="__kept")
    emptied = (F.size("spans") > 0) & (F.length("__kept") == 0)
    return _restored(rows.where(~emptied), docs, F.when(~F.col("__row")["null"], F.col("__kept")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that mostly consists of them goes."""
    rows = find_leaks(_carried(docs), common.read_table(spark, sf_dir, "benchmark"), cleaned_col="__clean", max_coverage=MOST_LEAKED)
    leaked = F.size("hits") > 0
    return _restored(rows.where(~leaked | F.col("__clean").isNotNull()), docs, F.when(leaked, F.col("__clean")).otherwise(F.col("text")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document, and what they decode to."""
    common.ship_package(spark)
    rows = bpe_encode(docs, _tokenizer("word_bpe_49k.json"), decoded_col="decoded")
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again, the one before it deleted."""
    docs = common.read_table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs

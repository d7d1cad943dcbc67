"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolake.llm import _common as common


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.bpe import bpe_encode

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe_encode(docs, _tokenizer("word_bpe_49k.json"), decoded_col="decoded")
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.token_counts import count_tokens

    return count_tokens(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("piece_bpe_32k.model")).drop("text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.decontaminate import find_leaks

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_leaks(docs, common.read_table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]), F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.toxicity import score_toxicity

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, common.read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.sharding import shard_documents

    return shard_documents(common.read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.simhash import near_duplicates

    rows = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.topk import top_k

    return top_k(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.chat import digest_conversations, format_conversations, message_events

    turns = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digest_conversations(format_conversations(message_events(turns.unionByName(added))))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.substring_dedup import remove_repeats

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return rows.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geolake.llm.records import fresh_folder, read_token_records, write_token_records

    docs = common.read_table(spark, sf_dir, "documents")
    files = write_token_records(docs, fresh_folder(spark, "records"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    rows = read_token_records(spark, files)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_decontamination, op4_toxicity, op5_sharding, op6_simhash, op7_topk, op8_chat, op9_suffix_dedup, op10_records)}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
        WITH words AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, w FROM (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
        ), item_words AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ), sized AS (
            SELECT item, w, least(10, len(w)) AS size FROM item_words WHERE len(w) > 0
        ), item_windows AS (
            SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
        ), sizes AS (SELECT DISTINCT size FROM sized),
        doc_windows AS (
            SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)
        ), found AS (SELECT doc_id, size, i, item FROM doc_windows JOIN item_windows USING (size, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
    """,
    "op8_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), e AS (
            SELECT *, length(replace(text, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) AS n FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + length(role) + 9) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}

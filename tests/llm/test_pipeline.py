import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_decontamination", "op7_topk", "op8_chat"])
def test_oracle(spark, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    key = sorted(got)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = corpus_pipeline.run(spark, DATA).collect()
    ids = [g.doc_id for g in got]
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= docs.count()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for g in got[:40]:
        assert np.frombuffer(g.ids, "<u4").tolist() == library.encode(g.text, add_special_tokens=False).ids and g.n_chars == len(g.text)
    seen = set()
    for g in sorted(got, key=lambda g: g.doc_id):
        own = g.text.encode()
        windows = {own[p : p + 50] for p in range(len(own) - 49)}
        seen_before = {w for w in windows & seen}
        assert len(seen_before) < 60, g.doc_id  # only what cuts have brought together
        seen |= windows


def test_stages_on_odd_rows(spark, corpus):
    """Columns that operators name their results after come back as they were."""
    clash = "cast(length(text) as long) as n_chars, 7.0D as score, 'p' as predicted, array(1) as spans, 'k' as kept, 3 as n_words, 'c' as cleaned, 'h' as hits, doc_id as items, false as held_out, 2 as longest_match, 'n' as `__null`"
    docs = corpus.select("doc_id", "text", "lang", "source").selectExpr("*", *clash.split(", "))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert rows and {(r.score, r.predicted, tuple(r.spans), r.kept, r.n_words, r.cleaned, r.hits, r.held_out, r.longest_match) for r in rows} == {(7.0, "p", (1,), "k", 3, "c", "h", False, 2)}, name
        assert all(r["items"] == r.doc_id and r.n_chars == (None if r.text is None else len(r.text)) for r in rows), name
        assert stage(spark, docs.limit(0), DATA).count() == 0

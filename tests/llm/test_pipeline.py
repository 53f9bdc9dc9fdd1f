"""The stages, one by one, on awkward rows and on the smallest tables."""

import duckdb

import __spark_entry__
import corpus_pipeline
from mediaqc.llm import bpe, exact_dedup
from mediaqc.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages_on_awkward_rows(spark, messy):
    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            if name != "byte_bpe":
                assert out.columns == messy.columns
            rows = out.count()
            assert given is docs or rows == 0
        docs = cut(stage(spark, docs, SF), name)
    assert docs.count() > 0


def test_pipeline_on_small_tables(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and all(r.n_tokens == len(r.ids) for r in out)
    path, pattern = bpe.vocabulary()
    v = bpe._Vocabulary(path)
    codec = bpe.Codec(v.tokens, v.table, pattern)
    assert all(codec.decode(r.ids).decode() == docs[r.doc_id] for r in out)
    assert max(sum(x.doc_id == r.doc_id for x in out) for r in out[:20]) <= 3


def test_names_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_exact_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.query(spark, SF).collect()) == want

"""The pipeline's stages on a small table, against brute force."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import sentencepiece_codec

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], DIR), "test"))
    accepted, distinct, apart, mixed, encoded = seen[1:]
    for d in (accepted, distinct, apart, mixed):
        assert d.columns == docs.columns and d.exceptAll(docs).count() == 0
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(accepted, "doc_id", "left_anti").count() <= 0.03 * good.count()
    first = {}
    for r in accepted.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in distinct.collect()} == set(first.values())

    from tests.llm.test_sets import brute

    groups = brute([(r.doc_id, r.text) for r in distinct.collect()])
    assert {r.doc_id for r in apart.collect()} == {c for _, c in groups.values()}
    assert 0 < mixed.count() <= apart.count()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    data = sentencepiece_codec.read_model()
    got = encoded.collect()
    assert {r.doc_id: sentencepiece_codec.decode_ids(data, [list(r.token_ids)])[0] for r in got} == texts
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    assert corpus_pipeline.run(spark, DIR).select("doc_id", "n_tokens").exceptAll(encoded.select("doc_id", "n_tokens")).count() == 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0

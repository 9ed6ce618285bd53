"""The queries of this package: thin wrappers that bind the operators to the tables and their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Target shares of tokens: less of the largest source, all topics alike.
TARGETS = {
    "source": {"src0": 0.15} | {f"src{k}": 0.85 / 19 for k in range(1, 20)} | {"other": 0.02},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14, "other": 0.02},
    "topic": {str(k): 1 / 8 for k in range(8)},
}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import weighted

    return weighted(_table(spark, sf_dir, "documents"), TARGETS)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import shard_plan

    return shard_plan(_table(spark, sf_dir, "documents"))


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import crc_mod
    from graphloom.llm.quality_mil import quality_model, scored

    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import crc_mod
    from graphloom.llm.toxicity_cnn import scored, toxicity_model

    docs = _table(spark, sf_dir, "documents")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = scored(docs.select(F.col("doc_id").alias("id"), "text"), model)
    return out.select(F.col("id").alias("doc_id"), (crc_mod("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.common import crc_mod
    from graphloom.llm.gru_lm import score_documents

    out = score_documents(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.topk_search import topk

    return topk(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sentencepiece_codec import digests

    return digests(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.token_alignment import alignment

    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.vector_codes import coded

    return coded(_table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_ngram_jaccard, op4_quality_mil, op5_html_extract, op6_sharding, op7_toxicity_cnn, op8_topk_search, op9_gru_lm, op10_sentencepiece, op11_token_alignment, op12_vector_codes, op13_packing)}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op8_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}

"""The queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import embedding_dup, fingerprints, lm_scoring, mixing, near_dup, nearest, quality_crf, sentencepiece_codec, spelling, token_counts, url_filters, vector_codes, warc
from .shared import crc32_of_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), piece_model(), limit=4096)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), piece_model())


def op4_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read_back(files).select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Shares of the expected tokens that op6 aims at, by quality and toxicity label.
MIX = {"quality1_toxic0": 0.85, "quality0_toxic0": 0.08, "quality1_toxic1": 0.055, "quality0_toxic1": 0.015}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), ("quality", "toxic"))
    rated, _, _ = mixing.mix(docs.select("doc_id", "text"), model, MIX, anchor="quality1_toxic0")
    take = mixing.copies(F.col("rate"), F.col("row.doc_id"))
    posterior = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(model.names)]
    return rated.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", *posterior, "rate", take.alias("copies"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(crc32_of_id("doc_id") % 3 != 1)
    model = quality_crf.train(docs, learn)
    rows = docs.select("doc_id", "text", F.coalesce(crc32_of_id("doc_id") % 3 == 1, F.lit(False)).alias("held_out"))
    return quality_crf.score(rows, model, keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"), piece_model(), crc32_of_id("doc_id") % 10 == 0)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_near_dup, op3_sentencepiece, op4_embedding_dup, op5_warc, op6_mixing, op7_quality, op8_fingerprints, op9_lm_scoring, op10_url_filters, op11_spelling, op12_vector_codes, op13_nearest)
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN t USING (d)""",
    "op10_url_filters": url_filters.oracle(),
    "op12_vector_codes": vector_codes.oracle(),
}

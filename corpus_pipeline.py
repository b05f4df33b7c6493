"""The corpus pipeline: quality filter, near-duplicate removal, mixing towards target weights, SentencePiece ids.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame. Each but the last returns the columns of
documents as they came. run() writes each stage's rows to the shared folder and reads them again as the next one's docs.

Defined results, beside those of the operators: rows whose id is null pass the near-duplicate stage; of several rows of one id
one stays there, the one with the smallest text (of rows alike in both, any one); extra columns are carried along, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import mixing, near_dup, quality_crf, sentencepiece_codec
from lexiloom.llm.queries import piece_model, table
from lexiloom.llm.shared import written

#: Rates this near to one are one copy; others are drawn by hash, so that the fitted totals are delivered.
NEAR_ONE = 0.25
#: The fit of the rates ends when no domain is off its target by more than this share of all tokens.
CLOSE = 1e-4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score_rows(docs, model).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near duplicates stays, the one with the smallest id."""
    found = written(near_dup.near_duplicates(docs), "pipeline_groups")
    gone = written(found.where("not kept").select("doc_id").distinct(), "pipeline_gone")
    few = gone.count() <= near_dup.MOST_BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
    again = written(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "pipeline_repeated")
    if again.isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that are likelier toxic go. The targets are the expected tokens of the others, so they hold for any part
    of toxic documents and any noise of the labels; copies are drawn by hash where a rate is away from one."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), ("toxic",))
    rated, _, _ = mixing.mix(docs, model, None, anchor="toxic0", keep_text=True, close=CLOSE)
    take = F.when(F.abs(F.col("rate") - 1) <= NEAR_ONE, 1).otherwise(mixing.copies(F.col("rate"), F.col("row.doc_id")))
    rows = rated.withColumn("take_", take).where("take_ > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("take_"))).alias("one_"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ids of every text, and whether they decode to it."""
    return sentencepiece_codec.encode(docs, piece_model())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pieces", pieces)]

#: The classifier, the groups and the rates have no SQL form; tests hold the operators against brute force, and what each stage keeps against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs

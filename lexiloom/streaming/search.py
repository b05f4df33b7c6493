"""An extension beyond batch search: standing queries over a stream of new works, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S


def works_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New documents, as they arrive in a folder of Parquet files, as works."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return docs.select(F.col("lang").alias("corpus"), F.col("source").alias("author"), F.col("doc_id").alias("work_id"), F.split("text", "\n").alias("lines"))


def standing_search(works: DataFrame, pattern: str) -> DataFrame:
    """The simple search over a stream: stateless, the same plan as in batch."""
    return S.simple(works, pattern)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark are dropped, and state is kept no longer."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

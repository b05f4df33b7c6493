"""The corpus as Spark tables. A work is one row that holds its lines, so that whatever looks at neighbouring lines is a narrow
transformation: no window, no shuffle, and no author whose rows meet in one task. Lines are rows only where an operator ends.

works: corpus, author, work_id, lines array<string>. Catalog tables (authors, works_catalog) never read texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BREAK = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def available(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """name and whether there is such a table; only footers are read."""

    def there(name: str) -> bool:
        try:
            return bool(table(spark, sf_dir, name).columns)
        except AnalysisException:
            return False

    return spark.createDataFrame([(n, there(n)) for n in names], "name string, present boolean")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_works(table(spark, sf_dir, "documents"))


def as_works(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").alias("corpus"), F.col("source").alias("author"), F.col("doc_id").alias("work_id"), F.split("text", LINE_BREAK).alias("lines"))


def lines(works_: DataFrame) -> DataFrame:
    """One row a line: idx counts from 1 within a work."""
    keys = [c for c in works_.columns if c != "lines"]
    return works_.select(*keys, F.posexplode("lines").alias("pos", "line")).withColumn("idx", F.col("pos") + 1).drop("pos")


def works_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of works, from columns other than the text; a date is null for every fifth work, and 2000 or 2500 stand for
    various and uncertain ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = F.col("doc_id")
    date = F.when(d % 5 == 0, None).when(d % 17 == 0, 2000).when(d % 19 == 0, 2500).otherwise((d * 37) % 1300 - 700).cast("int")
    title = F.concat(F.lit("doc "), d.cast("string"), F.when(F.col("quality") == 0, " [Sp.]").otherwise(""))
    genre = F.concat(F.col("lang"), F.lit(","), F.when(d % 3 == 0, "epic").when(d % 3 == 1, "hist").otherwise("phil"))
    return docs.join(marks, "doc_id", "left").select(F.col("lang").alias("corpus"), F.col("source").alias("author"), d.alias("work_id"), title.alias("title"), genre.alias("genre"), date.alias("date"), (d % 7).cast("int").alias("place_key"), F.col("n_chars").alias("size"))


def authors(catalog: DataFrame) -> DataFrame:
    """One row an author: its number, and a date for two of three."""
    n = F.regexp_replace("author", "[^0-9]", "").cast("int")
    date = F.when(n % 3 == 0, None).otherwise(n * 50 - 400).cast("int")
    return catalog.select("author").distinct().select("author", date.alias("author_date"), F.concat(F.lit("place "), (n % 4).cast("string")).alias("location"))

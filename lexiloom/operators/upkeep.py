"""Models of authors and of whole corpora kept up to date: what changed is built anew, what has gone is removed, all else is found as it is.

A worklist has one row for each author and each corpus: its words, and a digest of its works' ids and texts, summed map-side. The register says of which digest
and with which parameters a model was built. A model's folder is named by the two, so a builder that breaks off finds what it has finished when it starts again.

Defined results: a list with fewer than `least` words, or with `most` or more, has no model (a model it had goes). Works without lines count as without words."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import interim
from ..sources.postings import digest

LEAST_WORDS, MOST_WORDS = 500, 94_000_000
REGISTER = "kind string, name string, digest long, parameters string, path string"


def worklist(works: DataFrame) -> DataFrame:
    """kind (author or corpus), name, words, digest."""
    size = F.aggregate(F.coalesce("lines", F.array()), F.lit(0).cast("long"), lambda s, line: s + T.word_count(F.coalesce(line, F.lit(""))))
    each = works.select("author", "corpus", "work_id", size.alias("size"), F.xxhash64("lines").alias("h"))
    lists = each.select(F.explode(F.array(F.struct(F.lit("author").alias("kind"), F.col("author").alias("name")), F.struct(F.lit("corpus").alias("kind"), F.col("corpus").alias("name")))).alias("of"), "work_id", "size", "h")
    return lists.where("of.name is not null").groupBy("of.kind", "of.name").agg(F.sum("size").alias("words"), digest("work_id", "h").alias("digest"))


def states(lists: DataFrame, register: DataFrame, parameters: str, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """kind, name, words, digest, state: due, current, small, large; or gone, of what the register has and the corpus no longer."""
    had = register.select("kind", "name", F.col("digest").alias("had"), F.col("parameters").alias("with_"))
    both = lists.join(had, ["kind", "name"], "full")
    fits = (F.col("digest") == F.col("had")) & (F.col("with_") == parameters)
    state = F.when(F.col("words").isNull(), "gone").when(F.col("words") < least, "small").when(F.col("words") >= most, "large").when(F.coalesce(fits, F.lit(False)), "current").otherwise("due")
    return both.select("kind", "name", F.coalesce("words", F.lit(0)).alias("words"), "digest", state.alias("state"))


def register_of(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    """The last whole version of the register, and its number."""
    done = [int(n.split("=")[1]) for n in interim.children(spark, f"{root}/register") if n.startswith("version=") and interim.exists(spark, f"{root}/register/{n}/_SUCCESS")]
    if not done:
        return 0, spark.createDataFrame([], REGISTER)
    return max(done), spark.read.schema(REGISTER).parquet(f"{root}/register/version={max(done)}")


def maintain(works: DataFrame, root: str, fit: Callable[[DataFrame], DataFrame], parameters: dict, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> dict[str, int]:
    """Builds what is due, the smallest first: fit makes a model's table out of its works. How many models were built, found and removed."""
    spark = works.sparkSession
    told = json.dumps(parameters, sort_keys=True)
    version, register = register_of(spark, root)
    now = interim.written(states(worklist(works), register, told, least, most), "upkeep")
    built = []
    for r in now.where("state = 'due'").select("kind", "name", "words", "digest").orderBy("words", "kind", "name").toLocalIterator():
        path = f"{root}/model-{hashlib.md5(json.dumps([r.kind, r.name, r.digest, told]).encode()).hexdigest()}"
        if not interim.exists(spark, f"{path}/_SUCCESS"):
            fit(works.where(F.col(r.kind) == r.name)).write.mode("overwrite").parquet(path)
        built.append((r.kind, r.name, r.digest, told, path))
    kept = register.join(now.where("state = 'current'").select("kind", "name"), ["kind", "name"], "left_semi")
    rows = kept.unionByName(spark.createDataFrame(built, REGISTER))
    rows.coalesce(1).write.parquet(f"{root}/register/version={version + 1}")
    gone = [r.path for r in register.join(rows.select("path"), "path", "left_anti").select("path").toLocalIterator()]
    for path in gone:
        interim.delete(spark, path)
    found = spark.read.parquet(f"{root}/register/version={version + 1}").count() - len(built)
    if version:
        interim.delete(spark, f"{root}/register/version={version}")
    return {"built": len(built), "found": found, "removed": len(gone)}


def model_of(spark: SparkSession, root: str, kind: str, name: str) -> DataFrame | None:
    """The model's table, if there is one."""
    row = register_of(spark, root)[1].where((F.col("kind") == kind) & (F.col("name") == name)).first()
    return spark.read.parquet(row.path) if row else None

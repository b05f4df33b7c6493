"""Frequency statistics: counts by corpus and era, weights that even out their sizes, weighted distributions and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(tokens: DataFrame, key: str, values: list[str]) -> DataFrame:
    """word, total and one count for each value of key."""
    sums = [F.sum(F.when(F.col(key) == v, 1).otherwise(0)).alias(f"{v}_count") for v in values]
    return tokens.groupBy("word").agg(F.count("*").alias("total_count"), *sums)


def totals(counts: DataFrame, columns: list[str], script: str | None = None) -> DataFrame:
    """One row: sums of count columns, over entries that match a script's pattern."""
    rows = counts if script is None else counts.where(F.col("word").rlike(script))
    return rows.agg(*(F.sum(c).alias(c) for c in columns))


def weights(total: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """One row: what evens each column out to the largest, rounded; zero columns have none."""
    top = F.greatest(*(F.col(c) for c in columns))
    return total.select(*(F.when(F.col(c) > 0, F.round(top / F.col(c), digits)).alias(c) for c in columns))


def era(date: Column) -> Column:
    """early to -300, middle to 300, late beyond; sentinels and undated works are unknown."""
    return F.when(date.isNull() | (date >= 2000), "unknown").when(date <= -300, "early").when(date <= 300, "middle").otherwise("late")


def weighted(counts: DataFrame, weight_row: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Each entry's weighted counts, scaled so that its largest is 100. weight_row is one row."""
    w = weight_row.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(f"w_{c}") for c in columns))
    rows = counts.join(F.broadcast(w))  # a single row
    raw = {c: F.col(c) * F.col(f"w_{c}") for c in columns}
    top = F.greatest(*raw.values()) if len(columns) > 1 else raw[columns[0]]
    return rows.select("word", *(F.when(top > 0, F.round(100 * raw[c] / top, digits)).otherwise(0.0).alias(c) for c in columns))


def ranking(distribution: DataFrame, columns: list[str]) -> DataFrame:
    """Long form of a distribution: word, name, value and rank within the word."""
    long = distribution.unpivot("word", columns, "name", "value")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("value"), "name")))


def collapsed(distribution: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Columns of each group added up to one."""
    merged = {c for names in groups.values() for c in names}
    rest = [c for c in distribution.columns if c not in merged]
    return distribution.select(*rest, *(sum((F.col(c) for c in names), F.lit(0.0)).alias(name) for name, names in groups.items()))


def most_common(counts: DataFrame, n: int, without: list[str] = ()) -> DataFrame:
    rows = counts.where(~F.col("word").isin(*without)) if without else counts
    return rows.orderBy(F.desc("n"), "word").limit(n)


def unknown_era(total: Column, parts: list[Column]) -> Column:
    return total - sum(parts, F.lit(0))


def frequency_class(counts: DataFrame) -> DataFrame:
    """Decile-like classes of words by the power of ten of their count."""
    return counts.withColumn("class", F.floor(F.log10("n")).cast("int"))


def weights_to(total: DataFrame, columns: list[str], base: str, digits: int = 2) -> DataFrame:
    """One row: what evens each column out to the base's, rounded; zero columns have none."""
    return total.select(*(F.when(F.col(c) > 0, F.round(F.col(base) / F.col(c), digits)).alias(c) for c in columns))


def conditional_sums(rows: DataFrame, size: str, conditions: dict[str, Column]) -> DataFrame:
    """One row: the sum of a size over the rows that meet each condition."""
    return rows.agg(*(F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0)).alias(name) for name, c in conditions.items()))


def genre_weights(totals: DataFrame, groups: dict[str, list[str]] | None = None, digits: int = 2) -> DataFrame:
    """genre, n to genre, weight: the largest over n, rounded; genres without anything go. Groups are added up to genres of their own
    beside their parts, but do not set the scale."""
    rows = totals.where("n > 0").select("genre", "n", F.lit(False).alias("grouped"))
    for name, parts in (groups or {}).items():
        some = totals.where(F.col("genre").isin(*parts)).agg(F.sum("n").alias("n")).where("n > 0")
        rows = rows.unionByName(some.select(F.lit(name).alias("genre"), "n", F.lit(True).alias("grouped")))
    top = totals.agg(F.max("n").alias("top"))
    return rows.join(F.broadcast(top)).select("genre", F.round(F.col("top") / F.col("n"), digits).alias("weight"), "grouped")  # one row


def weighted_of_script(distribution: DataFrame, columns: list[str], script: str) -> DataFrame:
    """A weighted distribution for entries of one script only; the others have none."""
    fits = F.col("word").rlike(script)
    return distribution.select("word", *(F.when(fits, F.col(c)).alias(c) for c in columns))


def without_minor(weight_rows: DataFrame, most: float = 500.0) -> DataFrame:
    """Weights below a bound: what is so rare that it would lead every ranking goes."""
    return weight_rows.where(F.col("weight") < most)


def genre_ranking(counts: DataFrame, weight_rows: DataFrame, digits: int = 4) -> DataFrame:
    """word, genre, value, place: counts (word, genre, n) times the genres' weights, the word's largest being 100. Weights are one row a genre."""
    raw = counts.join(F.broadcast(weight_rows.select("genre", "weight")), "genre").select("word", "genre", (F.col("n") * F.col("weight")).alias("raw"))
    of_word = Window.partitionBy("word")  # one row a genre
    rows = raw.withColumn("value", F.round(100 * F.col("raw") / F.max("raw").over(of_word), digits)).where("value is not null")
    return rows.withColumn("place", F.row_number().over(of_word.orderBy(F.desc("value"), "genre"))).drop("raw")


def prevalence(total: Column, parts: dict[str, Column]) -> Column:
    """What a word's entry tells of its counts: each part that is not zero, and the total unless one part is all of it."""
    each = [F.when(c > 0, F.concat(F.lit(f"{name} "), c.cast("string"))) for name, c in parts.items()]
    most = F.greatest(*parts.values())
    return F.concat_ws(" / ", *each, F.when(total != most, F.concat(F.lit("total "), total.cast("string"))))

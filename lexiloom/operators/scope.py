"""Scope algebra: which works, and which lines of them, a search may look at. A scope is a table, joined, never a text of SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIOUS, UNCERTAIN = 2000, 2500


@dataclass(frozen=True)
class Scope:
    """What a session selects. Explicit works and authors ignore dates; spurious works stay only where named."""

    corpora: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    exact_genres: bool = False
    earliest: int | None = None
    latest: int | None = None
    various: bool = True
    uncertain: bool = True
    spurious: bool = True
    authors: tuple[str, ...] = ()
    works: tuple[int, ...] = ()
    without_authors: tuple[str, ...] = ()
    without_works: tuple[int, ...] = ()
    without_genres: tuple[str, ...] = field(default=())


def attribute(column: Column, values: tuple[str, ...], exact: bool) -> Column:
    """Whether a comma list holds one of some values; inexact: whether one is found anywhere in it."""
    if exact:
        return F.arrays_overlap(F.transform(F.split(column, ","), F.trim), F.array(*map(F.lit, values)))
    return column.rlike("|".join(values))


def effective_date(work: Column, author: Column) -> Column:
    return F.coalesce(work, author)


def in_dates(work: Column, author: Column, earliest: int, latest: int) -> Column:
    """The work's date, else the author's, lies in the span; undated works of undated authors stay."""
    date = effective_date(work, author)
    return date.isNull() | date.between(earliest, latest)


def sentinel(work: Column, author: Column, year: int) -> Column:
    """Various or uncertain works; those without any date belong to both."""
    date = effective_date(work, author)
    return date.isNull() | (date == year)


def is_spurious(title: Column) -> Column:
    return title.rlike(r"\[[Ss]p\.\]")


def compile_scope(catalog: DataFrame, authors: DataFrame, scope: Scope) -> DataFrame:
    """catalog rows (with author_date) of the scope. Authors are a small dimension next to works, joined as Spark decides."""
    rows = catalog.join(authors, "author", "left")
    work, author = F.col("date"), F.col("author_date")
    drawn = F.lit(True)
    if scope.corpora:
        drawn = drawn & F.col("corpus").isin(*scope.corpora)
    if scope.genres:
        drawn = drawn & attribute(F.col("genre"), scope.genres, scope.exact_genres)
    if scope.earliest is not None and scope.latest is not None:
        dated = in_dates(work, author, scope.earliest, scope.latest)
        date = effective_date(work, author)
        dated = dated | ((date == VARIOUS) & F.lit(scope.various)) | ((date == UNCERTAIN) & F.lit(scope.uncertain))
        drawn = drawn & dated
    named = F.col("author").isin(*scope.authors) | F.col("work_id").isin(*scope.works)
    if scope.authors or scope.works:
        drawn = (drawn & F.lit(bool(scope.genres))) | named
    if not scope.various:
        drawn = drawn & (~F.coalesce(effective_date(work, author) == VARIOUS, F.lit(False)) | named)
    if not scope.uncertain:
        drawn = drawn & (~F.coalesce(effective_date(work, author) == UNCERTAIN, F.lit(False)) | named)
    if not scope.spurious:
        drawn = drawn & (~is_spurious(F.col("title")) | F.col("work_id").isin(*scope.works))
    out = F.col("author").isin(*scope.without_authors) | F.col("work_id").isin(*scope.without_works)
    if scope.without_genres:
        out = out | attribute(F.col("genre"), scope.without_genres, False)
    return rows.where(drawn & ~out)


def whole_authors(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen works, those of an author of whom none is missing replaced by the author: scope_id."""
    total = catalog.groupBy("author").agg(F.count("*").alias("total"))
    some = chosen.select("author", "work_id").distinct()
    counted = some.groupBy("author").agg(F.count("*").alias("n")).join(total, "author")
    marked = some.join(counted.select("author", (F.col("n") == F.col("total")).alias("whole")), "author")
    return marked.select(F.when(F.col("whole"), F.col("author")).otherwise(F.concat("author", F.lit("w"), F.col("work_id").cast("string"))).alias("scope_id")).distinct()


def within_ranges(lines: DataFrame, ranges: DataFrame, omissions: DataFrame | None = None) -> DataFrame:
    """lines (work_id, idx) that lie in one of the ranges (work_id, first, last) and in none of the omissions. Ranges of a work are
    gathered in one row first, so each line meets one row of its work."""

    def gathered(r: DataFrame, name: str) -> DataFrame:
        return r.groupBy("work_id").agg(F.collect_set(F.struct("first", "last")).alias(name))

    inside = lambda r: (F.col("idx") >= r["first"]) & (F.col("idx") <= r["last"])
    out = lines.join(gathered(ranges, "in_"), "work_id").where(F.exists("in_", inside)).drop("in_")
    if omissions is not None:
        out = out.join(gathered(omissions, "out_"), "work_id", "left").where(F.coalesce(~F.exists("out_", inside), F.lit(True))).drop("out_")
    return out


def facets(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct values of comma lists by key, trimmed, without bracketed remarks."""
    parts = rows.select(*keys, F.explode(F.split(column, ",")).alias("part"))
    return parts.select(*keys, F.trim(F.regexp_replace("part", r"\[[^\]]*\]", "")).alias("value")).where("value <> ''").distinct()


def authors_in_full(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (language, abbreviation) with `author`: what a table of the language's abbreviations (language, abbreviation, author) says,
    else the abbreviation itself."""
    rows = asked.join(known, ["language", "abbreviation"], "left")
    return rows.withColumn("author", F.coalesce("author", "abbreviation"))


def fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """An md5 of a scope's sorted ids, by way of one digest of each id, so that nothing but digests meets: first those
    that begin with the same four digits, then one digest for each beginning."""
    one = ids.select(F.md5(F.col(column).cast("string")).alias("d")).distinct()
    return one.select(F.substring("d", 1, 4).alias("part"), "d").groupBy("part").agg(F.md5(F.array_join(F.sort_array(F.collect_list("d")), "")).alias("p")).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "p"))), lambda x: x["p"]), "")).alias("fingerprint"))

"""What a user picks: authors, works, passages and spans as ids, parsed from a request, kept free of contradictions, and turned into
ranges of lines. Ids: an author is a name; a work is author and `w` and number; a passage is a work and `_AT_` and levels from the
highest down, parted by bars; a span is a work and `_FROM_` line `_TO_` line."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LITERARY, DOCUMENTARY = ("en", "fr"), ("de", "es")


def parsed(request: dict[str, str]) -> tuple[str, str] | None:
    """The kind and id of a request's choice: author, work, locus, endpoint; genre or place; None where nothing is chosen."""
    value = lambda k: re.sub(r"[^\w| .,-]", "", request.get(k, "")).strip()
    author, work, locus, endpoint = (value(k) for k in ("author", "work", "locus", "endpoint"))
    if author and work and locus:
        name = f"{author}w{work}"
        if endpoint and locus.isdigit() and endpoint.isdigit():
            return "span", f"{name}_FROM_{locus}_TO_{endpoint}"
        return "passage", f"{name}_AT_{locus}"
    if author and work:
        return "work", f"{author}w{work}"
    if author:
        return "author", author
    return next(((k, value(k)) for k in ("genre", "place") if value(k)), None)


def _author(id_: str) -> str:
    return re.sub(r"w\d+(_.*)?$", "", id_)


def _work(id_: str) -> str:
    return id_.split("_AT_")[0].split("_FROM_")[0]


@dataclass(frozen=True)
class Choices:
    authors: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    passages: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selections:
    chosen: Choices = Choices()
    excluded: Choices = Choices()

    def add(self, kind: str, id_: str, excluded: bool = False) -> Selections:
        """With one more choice. An author takes the place of its works and passages; a work that of its author and its passages; a passage
        that of its work and author. The same thing and what lies within it go from the other side."""
        mine, other = (self.excluded, self.chosen) if excluded else (self.chosen, self.excluded)
        within = lambda ids, of: tuple(x for x in ids if of(x) != id_)
        if kind == "author":
            mine = Choices((*within(mine.authors, str), id_), within(mine.works, _author), within(mine.passages, _author))
            other = Choices(within(other.authors, str), within(other.works, _author), within(other.passages, _author))
        elif kind == "work":
            mine = Choices(tuple(x for x in mine.authors if x != _author(id_)), (*within(mine.works, str), id_), within(mine.passages, _work))
            other = replace(other, works=within(other.works, str), passages=within(other.passages, _work))
        else:
            mine = Choices(tuple(x for x in mine.authors if x != _author(id_)), tuple(x for x in mine.works if x != _work(id_)), (*within(mine.passages, str), id_))
            other = replace(other, passages=within(other.passages, str))
        return Selections(other, mine) if excluded else Selections(mine, other)


def only(corpora: tuple[str, ...], wanted: tuple[str, ...]) -> bool:
    """Whether a session looks at these corpora and no others."""
    return set(corpora) == set(wanted)


def are_only(corpora, wanted: tuple[str, ...]):
    """Column: only(), for a column that lists corpora."""
    return F.array_sort(F.array_distinct(corpora)) == F.array_sort(F.array(*map(F.lit, dict.fromkeys(wanted))))


def is_literary(corpus):
    """Column: whether a corpus is one of literary texts."""
    return corpus.isin(*LITERARY)


def flagged(scope_ids: DataFrame, excluded_passages: DataFrame) -> DataFrame:
    """scope_id, with x in place of the w of a work some passage of which is excluded (column passage); other ids stay."""
    works = excluded_passages.select(F.regexp_extract("passage", r"^(.*w\d+)_", 1).alias("scope_id")).distinct().withColumn("hit_", F.lit(True))
    marked = scope_ids.join(works, "scope_id", "left")
    return marked.select(F.when(F.col("hit_"), F.regexp_replace("scope_id", r"w(\d+)$", "x$1")).otherwise(F.col("scope_id")).alias("scope_id"))


def whole_corpora(catalog: DataFrame, scope_ids: DataFrame) -> DataFrame:
    """corpus and whether all its authors (by the catalog) are among the ids."""
    authors = catalog.select("corpus", "author").distinct()
    marked = authors.join(scope_ids.select(F.col("scope_id").alias("author")).distinct().withColumn("hit_", F.lit(1)), "author", "left")
    return marked.groupBy("corpus").agg((F.count("*") == F.count("hit_")).alias("whole"))


def boundaries(selections: DataFrame, cited: DataFrame) -> DataFrame:
    """selection, work_id, first, last of passages and spans. A passage covers the lines whose levels equal those given; one that fits
    none has no row. cited: work_id, idx, l1, l0. Only lines of works named are looked at."""
    work = F.regexp_extract("selection", r"w(\d+)_(AT|FROM)_", 1).cast("long")
    rows = selections.withColumn("work_id", work)
    span = rows.where(F.contains("selection", F.lit("_FROM_"))).select("selection", "work_id", F.regexp_extract("selection", r"_FROM_(\d+)_", 1).cast("int").alias("first"), F.regexp_extract("selection", r"_TO_(\d+)$", 1).cast("int").alias("last"))
    at = rows.where(F.contains("selection", F.lit("_AT_"))).withColumn("levels", F.split(F.regexp_extract("selection", r"_AT_(.*)$", 1), "\\|"))
    fits = (F.col("l1").cast("string") == F.get("levels", F.lit(0))) & ((F.size("levels") < 2) | (F.col("l0").cast("string") == F.get("levels", F.lit(1))))
    passage = cited.join(at, "work_id").where(fits).groupBy("selection", "work_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return span.unionByName(passage)


def text_of(request: dict[str, str], cited: DataFrame) -> DataFrame:
    """The lines that a request asks for: a whole work, the lines of a passage, or those of a span; of an author all works. cited: author,
    work_id, idx, l1, l0, line."""
    choice = parsed(request)
    if choice is None:
        return cited.limit(0)
    kind, id_ = choice
    if kind == "author":
        return cited.where(F.col("author") == id_)
    work = int(re.search(r"w(\d+)", id_.removeprefix(_author(id_)))[1])
    lines = cited.where((F.col("author") == _author(id_)) & (F.col("work_id") == work))
    if kind == "work":
        return lines
    asked = cited.sparkSession.createDataFrame([(id_,)], "selection string")
    ends = boundaries(asked, lines).select("work_id", "first", "last")
    return lines.join(F.broadcast(ends), "work_id").where("idx between first and last").drop("first", "last")  # one row

"""Browsing by citation: levels of a work's lines, spans, changes of level, brackets that stay open, autocompletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cited(works: DataFrame, per_section: int = 5) -> DataFrame:
    """works with `rows`: idx, l1 (section), l0 (line within it), line."""
    rows = F.transform("lines", lambda line, i: F.struct((i + 1).alias("idx"), (F.floor(i / per_section) + 1).cast("int").alias("l1"), ((i % per_section) + 1).cast("int").alias("l0"), line.alias("line")))
    return works.withColumn("rows", rows).drop("lines")


def cited_lines(works: DataFrame, per_section: int = 5) -> DataFrame:
    rows = cited(works, per_section)
    keys = [c for c in rows.columns if c != "rows"]
    return rows.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")


def locus(levels: list[Column]) -> Column:
    """Levels from the highest down, joined by points; -1 marks a level that a work lacks."""
    return F.concat_ws(".", *(F.when(c.cast("string") != "-1", c.cast("string")) for c in levels))


def prolix_locus(labels: list[str], levels: list[Column]) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{label} "), c.cast("string")) for label, c in zip(labels, levels)))


def span(lines: DataFrame, work_id, first: int, last: int) -> DataFrame:
    return lines.where((F.col("work_id") == work_id) & F.col("idx").between(first, last)).orderBy("idx")


def level_values(lines: DataFrame, levels: tuple[str, ...] = ("l1", "l0"), **fixed) -> DataFrame:
    """Values of the highest level that is not fixed, where the others are: work_id, value, first and last line, and its place among the
    work's values, by number where all are numbers, else by text."""
    rows = lines
    for name, value in fixed.items():
        rows = rows.where(F.col(name) == value)
    level = next(x for x in levels if x not in fixed)
    found = rows.groupBy("work_id", F.col(level).cast("string").alias("value")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    number = F.col("value").try_cast("bigint")
    numeric = F.min(number.isNotNull()).over(Window.partitionBy("work_id"))  # the values of one level of a work
    order = Window.partitionBy("work_id").orderBy(F.when(F.col("numeric"), number), "value")
    return found.withColumn("numeric", numeric).withColumn("place", F.row_number().over(order)).drop("numeric")


def structure(lines: DataFrame, labels: dict[str, str], **fixed) -> DataFrame:
    """What a work offers below fixed levels: label of the next level, lowest and highest value, and how many there are."""
    level = next(x for x in labels if x not in fixed)
    values = level_values(lines, tuple(labels), **fixed)
    ends = values.groupBy("work_id").agg(F.min_by("value", "place").alias("low"), F.max_by("value", "place").alias("high"), F.count("*").alias("values"))
    return ends.select("work_id", F.lit(labels[level]).alias("label"), "low", "high", "values")


def foreign_levels(citation: Column) -> Column:
    """Levels of a citation written elsewhere, highest first: labels and blanks go, a range keeps its beginning, and points, colons and
    commas part levels (`bk. 2, l. 3-7` is 2 and 3)."""
    bare = F.regexp_replace(F.lower(citation), r"\b[a-z]+\.?\s*(?=\d)|[\s()\[\]]", "")
    return F.filter(F.split(F.regexp_replace(bare, r"-[^.:,]*", ""), "[.:,]"), lambda x: x != "")


def resolve_citations(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """asked: ask, work_id, citation. The line of each: a full locus; else, of three or more levels, without the second; else the first
    line of the highest level; else the work's first line. ask, work_id, idx, rung (which of these it was)."""
    rows = asked.select("ask", "work_id", foreign_levels(F.col("citation")).alias("c"))
    pair = lambda a, b: F.struct(F.get("c", F.lit(a)).alias("a"), F.get("c", F.lit(b)).alias("b"))
    tries = F.array(F.struct(F.lit(1).alias("rung"), F.when(F.size("c") == 2, pair(0, 1)).alias("at")), F.struct(F.lit(2).alias("rung"), F.when(F.size("c") > 2, pair(0, 2)).alias("at")), F.struct(F.lit(3).alias("rung"), F.when(F.size("c") >= 1, pair(0, 99)).alias("at")))
    rows = rows.select("ask", "work_id", F.explode(tries).alias("t")).select("ask", "work_id", "t.rung", "t.at")
    fits = F.col("at").isNotNull() & (F.col("l1").cast("string") == F.col("at.a")) & (F.col("at.b").isNull() | (F.col("l0").cast("string") == F.col("at.b")))
    found = lines.select("work_id", "idx", "l1", "l0").join(rows, "work_id").where(fits).groupBy("ask", "work_id", "rung").agg(F.min("idx").alias("idx"))
    last = asked.join(lines.groupBy("work_id").agg(F.min("idx").alias("idx")), "work_id").select("ask", "work_id", F.lit(4).alias("rung"), "idx")
    best = found.unionByName(last).groupBy("ask", "work_id").agg(F.min(F.struct("rung", "idx")).alias("best"))
    return best.select("ask", "work_id", "best.idx", "best.rung")


def around(places: DataFrame, lines: DataFrame, context: int) -> DataFrame:
    """The lines at most `context` before and after each place (ask, work_id, idx), in its work only: ask, work_id, at, idx, line."""
    wanted = places.select("ask", "work_id", F.col("idx").alias("at"))
    rows = lines.select("work_id", "idx", "line").join(wanted, "work_id").where(F.abs(F.col("idx") - F.col("at")) <= context)
    return rows.select("ask", "work_id", "at", "idx", "line")


def first_and_last(lines: DataFrame) -> DataFrame:
    return lines.groupBy("work_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def sample_citations(lines: DataFrame) -> DataFrame:
    """First and last locus of each work."""
    where = locus([F.col("l1"), F.col("l0")])
    return lines.groupBy("work_id").agg(F.min_by(where, "idx").alias("low"), F.max_by(where, "idx").alias("high"))


def resolve_locus(lines: DataFrame, l1: int | None = None, l0: int | None = None, last: bool = False) -> DataFrame:
    """The line of a full or incomplete locus: the first (or last) whose given levels fit."""
    rows = lines
    rows = rows if l1 is None else rows.where(F.col("l1") == l1)
    rows = rows if l0 is None else rows.where(F.col("l0") == l0)
    return rows.groupBy("work_id").agg((F.max if last else F.min)("idx").alias("idx"))


def level_changes(rows: DataFrame, key: str, order: str, level: str, every: int) -> DataFrame:
    """Whether a row's level differs from the one before (by key), and whether its number is shown: every `every`-th, and not
    right after another shown one."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce(F.lag(level).over(w) != F.col(level), F.lit(True))
    number = F.col(order) % every == 0
    return rows.withColumn("changed", changed).withColumn("shown", number & ~F.coalesce(F.lag(number).over(w), F.lit(False)))


def bracket_state(works: DataFrame, kind: str = "round", per_section: int | None = None) -> DataFrame:
    """Lines with whether a bracket is still open at their end: opened there, or before and not closed since. Where sections are given
    (so many lines each), a new one begins with nothing open."""
    events = F.transform("lines", lambda line, i: F.struct((i + 1).alias("idx"), F.when(T.opens_bracket(line, kind), 1).when(T.closes_bracket(line, kind), 0).alias("event")))
    keys = [c for c in works.columns if c != "lines"]
    rows = works.select(*keys, F.explode(events).alias("e")).select(*keys, "e.*")
    section = [] if per_section is None else [F.floor((F.col("idx") - 1) / per_section)]
    w = Window.partitionBy("work_id", *section).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("open", F.coalesce(F.last("event", ignorenulls=True).over(w), F.lit(0)))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value that was not null so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def autocomplete(rows: DataFrame, column: str, prefix: str, cap: int = 50) -> DataFrame:
    """Distinct values that begin with the prefix, whatever their case and with or without a bracket before it, sorted; cap of them."""
    return rows.where(F.startswith(F.regexp_replace(F.lower(column), r"^[\[(<⟨{]+", ""), F.lit(prefix.lower()))).select(column).distinct().orderBy(column).limit(cap)


def lemma_hints(rows: DataFrame, column: str, typed: str, cap: int = 50) -> DataFrame:
    """Distinct values that begin with what is typed, both folded; at least two letters are wanted; cap of them."""
    if len(typed) < 2:
        return rows.select(column).limit(0)
    start = T.fold(F.lit(typed))
    return rows.where(F.startswith(T.fold(F.col(column)), start)).select(column).distinct().orderBy(column).limit(cap)


def labelled_hints(rows: DataFrame, name: str, id_: str, typed: str, cap: int = 50) -> DataFrame:
    """`name [id]` of the rows whose name begins with what is typed, sorted; cap of them."""
    label = F.concat(F.col(name), F.lit(" ["), F.col(id_).cast("string"), F.lit("]"))
    return rows.where(F.startswith(F.lower(name), F.lit(typed.lower()))).select(label.alias("hint")).distinct().orderBy("hint").limit(cap)


def starting_with(rows: DataFrame, column: str, start: str) -> DataFrame:
    """The part of a dictionary that begins so, folded."""
    return rows.where(F.startswith(T.fold(F.col(column)), T.fold(F.lit(start)))).select(column).distinct()


def by_prefix(rows: DataFrame, column: str) -> DataFrame:
    """How many distinct values begin with each two letters (folded), and the first of them."""
    return rows.select(column).distinct().groupBy(F.substring(T.fold(F.col(column)), 1, 2).alias("prefix")).agg(F.count("*").alias("n"), F.min(column).alias("first"))


def metadata(column: Column, name: str) -> Column:
    """The value of a named attribute in markup."""
    return F.regexp_extract(column, rf'{name}="([^"]*)"', 1)

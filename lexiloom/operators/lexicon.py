"""Dictionary and morphology: lookups with fallback ladders as prioritised unions, neighbours of an entry, tables of forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.interim import written


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows sorted, with `place` from 1. The sort is spread over ranges; a row's place is its place in its range, and the sizes of the ranges before it, one number a range."""
    names = rows.columns
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place within it in the lower 33
    sorted_ = written(rows.orderBy(*order).withColumn("at_", at), "ranked").withColumn("range_", F.shiftright("at_", 33))
    sizes = sorted_.groupBy("range_").agg(F.count("*").alias("size_"))
    before = sizes.withColumn("before_", F.sum("size_").over(Window.partitionBy(F.lit(0)).orderBy("range_")) - F.col("size_")).drop("size_")
    within = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(before), "range_").select(*(f"`{c}`" for c in names), (within + F.col("before_") + 1).alias("place"))


def reverse_lookup(entries: DataFrame, counts: DataFrame, term: str) -> DataFrame:
    """Entries whose translations hold the term, with their place by total count (ties by entry), those without one last."""
    rows = entries.where(F.col("translations").rlike(term))
    return ranked(rows.join(counts, "entry", "left").select("entry", "translations", F.coalesce("total", F.lit(0)).alias("total")), F.desc("total"), "entry")


def headword_search(entries: DataFrame, term: str) -> DataFrame:
    """Entries by a term whose blanks anchor it: on both sides, at the beginning, at the end, or nowhere."""
    bare = term.strip()
    if term.startswith(" ") and term.endswith(" "):
        return entries.where(F.col("entry") == bare)
    if term.startswith(" "):
        return entries.where(F.startswith("entry", F.lit(bare)))
    if term.endswith(" "):
        return entries.where(F.endswith("entry", F.lit(bare)))
    return entries.where(F.contains("entry", F.lit(bare)))


def ladder(asked: DataFrame, entries: DataFrame, rewrites: list[Column], key: str = "entry") -> DataFrame:
    """Each asked term with the entries of the first rewrite that finds any: term, rung, and the entry's columns. One join on all
    rewrites, then the lowest rung of each term."""
    rungs = F.array(*(F.struct(F.lit(k + 1).alias("rung"), r.alias("probe")) for k, r in enumerate(rewrites)))
    probes = asked.select("term", F.explode(rungs).alias("p")).select("term", "p.rung", "p.probe").where("probe is not null")
    probes = probes.groupBy("term", "probe").agg(F.min("rung").alias("rung"))
    found = probes.join(entries.withColumnRenamed(key, "probe"), "probe")
    best = found.groupBy("term").agg(F.min("rung").alias("rung"))
    return found.join(best, ["term", "rung"]).withColumnRenamed("probe", key)


def neighbours(entries: DataFrame, buckets: int = 64) -> DataFrame:
    """Each entry with the entry before and after it by id. Ids are cut into ranges of equal width for the windows; a range's first
    and last entries are matched across ranges by their summary rows, one a range."""
    span = entries.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    rows = entries.join(F.broadcast(span))  # one row
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / buckets), F.lit(1))
    rows = rows.withColumn("part", F.floor((F.col("id") - F.col("lo")) / width)).drop("lo", "hi")
    w = Window.partitionBy("part").orderBy("id")
    ends = rows.groupBy("part").agg(F.max_by("entry", "id").alias("last"), F.min_by("entry", "id").alias("first"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("last").over(line).alias("left"), F.lead("first").over(line).alias("right"))
    rows = rows.withColumn("before", F.lag("entry").over(w)).withColumn("after", F.lead("entry").over(w)).join(F.broadcast(ends), "part")
    return rows.select("id", "entry", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))


def with_counts(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Entries with their count, 0 where none is known."""
    return entries.join(counts, "entry", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def parse_analysis(column: Column) -> Column:
    """An analysis such as `fut ind act 3rd sg (attic epic)` or `masc/fem nom pl`: kind, the words, and the dialects in brackets."""
    bare = F.trim(F.regexp_replace(column, r"\([^)]*\)", ""))
    parts = F.split(bare, r"\s+")
    dialects = F.filter(F.split(F.regexp_extract(column, r"\(([^)]*)\)", 1), r"\s+"), lambda d: d != "")
    verbal = F.get(parts, F.lit(0)).isin("pres", "imperf", "fut", "aor", "perf", "plup", "futperf")
    return F.struct(F.when(verbal, "conjugated").otherwise("declined").alias("kind"), parts.alias("parts"), dialects.alias("dialects"))


def declension(forms: DataFrame, genders: list[str], cases: list[str], numbers: list[str]) -> DataFrame:
    """A row for each headword, case and number, a column for each gender: forms with counts joined by slashes, --- where none. forms:
    headword, form, analysis, n; slashes in an analysis stand for each of their parts. A cell holds one headword's forms."""
    p = F.split("analysis", r"\s+")
    rows = forms.select("headword", "form", "n", F.explode(F.split(F.get(p, F.lit(0)), "/")).alias("gender"), F.get(p, F.lit(1)).alias("cases"), F.get(p, F.lit(2)).alias("number"))
    rows = rows.select("headword", "form", "n", "gender", F.explode(F.split("cases", "/")).alias("case"), "number")
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("form", "n"))), lambda x: F.concat(x["form"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), " / ")
    cell = F.when(cell != "", cell)
    rows = rows.where(F.col("case").isin(*cases) & F.col("number").isin(*numbers))
    return rows.groupBy("headword", "case", "number").pivot("gender", genders).agg(cell).fillna("---", genders)


def mostly_conjugated(analyses: DataFrame) -> DataFrame:
    """headword and whether most of its analyses are verbal."""
    verbal = parse_analysis(F.col("analysis"))["kind"] == "conjugated"
    return analyses.groupBy("headword").agg((F.sum(F.when(verbal, 1).otherwise(-1)) > 0).alias("conjugated"))


def entry_summaries(body: Column) -> Column:
    """What an entry's markup names: senses, quotes that are no forms of its own, authors; each distinct and sorted."""
    every = lambda tag: F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1))))
    return F.struct(every("sense").alias("senses"), F.array_except(every("quote"), every("orth")).alias("quotes"), every("author").alias("authors"))


def superscript_free(column: Column) -> Column:
    return F.regexp_replace(column, "[⁰¹²³⁴⁵⁶⁷⁸⁹]+$", "")


def reverse_search(dictionaries: dict[str, DataFrame], counts: DataFrame, term: str) -> DataFrame:
    """reverse_lookup over several dictionaries (by name) at once: dictionary, entry, translations, total, place; an entry that several hold is
    told once for each."""
    rows = None
    for name, entries in dictionaries.items():
        part = entries.select(F.lit(name).alias("dictionary"), "entry", "translations")
        rows = part if rows is None else rows.unionByName(part)
    found = rows.where(F.col("translations").rlike(term)).join(counts, "entry", "left").select("dictionary", "entry", "translations", F.coalesce("total", F.lit(0)).alias("total"))
    return ranked(found, F.desc("total"), "entry", "dictionary")


def look_up(asked: DataFrame, entries: DataFrame, forms: DataFrame) -> DataFrame:
    """asked: term as typed. entries: id, entry. forms: form, headword. Terms are normalised, then looked for as entries, as entries without
    superscripts, and as forms of entries: term, rung, id, entry, each entry once a term."""
    from ..functions import text as T

    asked = asked.select("term", T.lemma_form(F.trim("term")).alias("probe"))
    bare = entries.select("id", "entry", superscript_free(F.lower("entry")).alias("bare"))
    exact = asked.join(bare, F.col("probe") == F.lower("entry")).select("term", F.lit(1).alias("rung"), "id", "entry")
    plain = asked.join(bare, F.col("probe") == F.col("bare")).select("term", F.lit(2).alias("rung"), "id", "entry")
    parsed = asked.join(forms, F.col("probe") == F.col("form")).join(bare, F.col("headword") == F.col("bare")).select("term", F.lit(3).alias("rung"), "id", "entry")
    found = exact.unionByName(plain).unionByName(parsed)
    best = found.groupBy("term").agg(F.min("rung").alias("rung"))
    return found.join(best, ["term", "rung"]).distinct()


def by_inflected_form(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """term, headword, forms: the headwords that an inflected form may belong to, each with all the forms that are known of it."""
    from ..functions import text as T

    mine = asked.select("term", T.lemma_form("term").alias("form")).join(forms, "form").select("term", "headword").distinct()
    known = forms.join(mine.select("headword").distinct(), "headword", "left_semi").groupBy("headword").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return mine.join(known, "headword").select("term", "headword", "forms")


def by_cross_reference(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked: xref, entry. The entry of a cross reference by its own name, else without superscripts: xref, id, entry. Of entries of one name only the one
    that would be told is joined, so that references to a common name do not meet all entries of it."""
    named = entries.groupBy("entry").agg(F.min("id").alias("id"))
    plain = entries.groupBy(superscript_free(F.col("entry")).alias("bare")).agg(F.min(F.struct("id", "entry")).alias("e"))
    one = asked.join(named, "entry").select("xref", F.lit(1).alias("rung"), "id", "entry")
    two = asked.select("xref", superscript_free(F.col("entry")).alias("bare")).join(plain, "bare").select("xref", F.lit(2).alias("rung"), "e.id", "e.entry")
    best = one.unionByName(two).groupBy("xref").agg(F.min(F.struct("rung", "id", "entry")).alias("b"))
    return best.select("xref", "b.id", "b.entry")

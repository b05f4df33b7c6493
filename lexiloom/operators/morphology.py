"""Analyses of forms: parts of speech, base forms, tables of verbs and nouns by dialect, principal parts, what a headword's forms show.

An analysis row: headword, form, entry (as the parser writes it: `base`, `seen, base` or `prefix-stem`, several prefixes parted by
commas), prefixes (how many there are), analysis (`fut ind act 3rd sg (attic epic)`, `masc/fem nom pl`), n (how often the form occurs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TENSES = ("pres", "imperf", "fut", "aor", "perf", "plup", "futperf")
MOODS = ("ind", "subj", "opt", "imperat", "inf", "part")
VOICES = ("act", "mid", "pass", "mp")
PERSONS = ("1st", "2nd", "3rd")
NUMBERS = ("sg", "dual", "pl")
GENDERS = ("masc", "fem", "neut")
CASES = ("nom", "gen", "dat", "acc", "abl", "voc")
#: Where an analysis names no dialect.
COMMON = "common"
# fixed values: tense, mood, voice, person and number (or gender and case) of principal parts by number
GREEK_PARTS = {1: "pres ind act 1st sg", 2: "fut ind act 1st sg", 3: "aor ind act 1st sg", 4: "perf ind act 1st sg", 5: "perf ind mp 1st sg", 6: "aor ind pass 1st sg"}
LATIN_PARTS = {1: "pres ind act 1st sg", 2: "pres inf act", 3: "perf ind act 1st sg", 4: "perf part pass masc nom sg"}


def words_of(analysis: Column) -> Column:
    """The words of an analysis, slashes parted, without dialects."""
    return F.array_distinct(F.split(F.trim(F.regexp_replace(analysis, r"\([^)]*\)", "")), r"[\s/]+"))


def dialects_of(analysis: Column) -> Column:
    found = F.filter(F.split(F.regexp_extract(analysis, r"\(([^)]*)\)", 1), r"\s+"), lambda d: d != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(COMMON)))


def _any(words: Column, some: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, some)))


def is_verb(analysis: Column, lemmatized: bool = True) -> Column:
    """Whether an analysis is a finite verb's: of headwords the first person tells, of forms any person."""
    return _any(words_of(analysis), PERSONS[:1] if lemmatized else PERSONS)


def is_noun(analysis: Column, lemmatized: bool = True) -> Column:
    """Whether it is a noun's or adjective's: of headwords the nominative tells, of forms any gender; participles and voices don't count."""
    words = words_of(analysis)
    return _any(words, ("nom",) if lemmatized else GENDERS) & ~_any(words, ("part", "pass", "act"))


def possibilities(observed: DataFrame) -> DataFrame:
    """form, k, entry, analysis: a row for each of a form's possible analyses (a map from number to entry and analysis)."""
    return observed.select("form", F.explode("possible").alias("k", "p")).select("form", "k", "p.entry", "p.analysis")


def base_form(entry: Column, greek: bool) -> Column:
    """The headword that a parser's entry stands for: what comes last of `seen, base`; a prefix and a stem put together, innermost
    prefix first."""
    last = F.trim(F.element_at(F.split(entry, ", "), -1))
    join = T.elided_prefix if greek else T.joined_prefix
    stem = F.element_at(F.split(last, "-"), -1)
    prefixes = F.reverse(F.split(F.get(F.split(last, "-"), F.lit(0)), ","))
    prefixes = F.transform(prefixes, lambda p: F.translate(F.trim(p), "άέίόύήώ", "αειουηω")) if greek else prefixes
    whole = F.aggregate(prefixes, stem, lambda done, p: join(p, done))
    return F.when(F.contains(last, F.lit("-")), whole).otherwise(last)


def known_attributes(analyses: DataFrame) -> DataFrame:
    """headword with the distinct dialects, voices (mp stands for both) and genders of its forms, sorted."""
    words = words_of(F.col("analysis"))
    of = lambda some: F.filter(words, lambda w: w.isin(*some))
    voices = F.flatten(F.transform(of(VOICES), lambda v: F.when(v == "mp", F.array(F.lit("mid"), F.lit("pass"))).otherwise(F.array(v))))
    rows = analyses.select("headword", dialects_of(F.col("analysis")).alias("d"), voices.alias("v"), of(GENDERS).alias("g"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("headword").agg(every("d").alias("dialects"), every("v").alias("voices"), every("g").alias("genders"))


def _cells(rows: DataFrame, keys: list[str], pivot: str, values: tuple[str, ...]) -> DataFrame:
    """A column for each value: forms with counts, sorted, joined by slashes; --- where none. One headword's forms make a cell."""
    cell = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("form", "n"))), lambda x: F.concat(x["form"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), " / ")
    cell = F.when(cell != "", cell)
    return rows.groupBy(*keys).pivot(pivot, list(values)).agg(cell).fillna("---", list(values))


def _one(words: Column, some: tuple[str, ...]) -> Column:
    return F.get(F.filter(words, lambda w: w.isin(*some)), F.lit(0))


def declension_table(analyses: DataFrame) -> DataFrame:
    """headword, dialect, number, case and a column for each gender. Several genders, cases and dialects of a form are a cell each."""
    words = F.col("w")
    rows = analyses.withColumn("w", words_of(F.col("analysis"))).where(_any(words, CASES) & ~_any(words, TENSES))
    of = lambda some: F.explode(F.filter("w", lambda x: x.isin(*some)))
    rows = rows.withColumn("dialect", F.explode(dialects_of(F.col("analysis")))).withColumn("number", _one(words, NUMBERS)).withColumn("case", of(CASES)).withColumn("gender", of(GENDERS))
    return _cells(rows, ["headword", "dialect", "number", "case"], "gender", GENDERS)


def verb_table(analyses: DataFrame) -> DataFrame:
    """headword, dialect, mood, voice, number, person and a column for each tense. Middle-passive forms stand in both voices; participles
    have gender and case in place of the person."""
    words = F.col("w")
    rows = analyses.withColumn("w", words_of(F.col("analysis"))).where(_any(words, TENSES))
    voice = _one(words, VOICES)
    rows = rows.withColumn("dialect", F.explode(dialects_of(F.col("analysis")))).withColumn("voice", F.explode(F.when(voice == "mp", F.array(F.lit("mid"), F.lit("pass"))).otherwise(F.array(voice))))
    nominal = F.filter("w", lambda x: x.isin(*GENDERS))
    cases = F.filter("w", lambda x: x.isin(*CASES))
    places = F.flatten(F.transform(nominal, lambda g: F.transform(cases, lambda c: F.concat_ws(" ", g, c))))
    person = F.when(F.array_contains(words, "part"), places).otherwise(F.array(F.coalesce(_one(words, PERSONS), F.lit("-"))))
    rows = rows.select("headword", "form", "n", "dialect", _one(words, MOODS).alias("mood"), "voice", F.coalesce(_one(words, NUMBERS), F.lit("-")).alias("number"), F.explode(person).alias("person"), _one(words, TENSES).alias("tense"))
    return _cells(rows, ["headword", "dialect", "mood", "voice", "number", "person"], "tense", TENSES)


def known_forms(analyses: DataFrame, headword: str) -> DataFrame:
    """All cells of one headword, whichever kind most of its analyses are: what, row, column, cell."""
    mine = analyses.where(F.col("headword") == headword)
    verb, noun = verb_table(mine), declension_table(mine)
    long = lambda t, what, keys, values: t.unpivot([F.concat_ws(" ", *keys).alias("row")], list(values), "column", "cell").withColumn("what", F.lit(what))
    rows = long(verb, "verb", ["dialect", "mood", "voice", "number", "person"], TENSES).unionByName(long(noun, "noun", ["dialect", "number", "case"], GENDERS))
    return rows.where("cell <> '---'").select("what", "row", "column", "cell")


def principal_parts(analyses: DataFrame, greek: bool) -> DataFrame:
    """headword, part, form, exact: the forms of each principal part; where there is none, the nearest: those that share tense, mood,
    voice and person, then tense, mood, voice and number, then tense, mood and voice, then (not for Greek parts 5 and 6) tense, mood,
    person and number, then tense and mood; the first of them by the alphabet. Parts that nothing comes near to have a null form."""
    parts = GREEK_PARTS if greek else LATIN_PARTS
    table = F.array(*(F.struct(F.lit(k).alias("part"), F.split(F.lit(v), " ").alias("want")) for k, v in parts.items()))
    verbs = analyses.withColumn("w", words_of(F.col("analysis"))).where(_any(F.col("w"), TENSES)).select("headword", "form", "w")
    rows = verbs.select("headword", "form", "w", F.explode(table).alias("p")).select("headword", "form", "w", "p.part", "p.want")
    same = lambda some: F.sort_array(F.filter("w", lambda x: x.isin(*some))) == F.sort_array(F.filter("want", lambda x: x.isin(*some)))
    tense, mood, voice, person, number = (same(x) for x in (TENSES, MOODS, VOICES, PERSONS, NUMBERS))
    exact = tense & mood & voice & person & number & same(GENDERS) & same(CASES)
    loose = F.lit(not greek) | ~F.col("part").isin(5, 6)
    rung = F.when(exact, 0).when(tense & mood & voice & person, 1).when(tense & mood & voice & number, 2).when(tense & mood & voice, 3).when(loose & tense & mood & person & number, 4).when(loose & tense & mood, 5)
    best = Window.partitionBy("headword", "part").orderBy("rung", "form")  # one headword's forms
    found = rows.withColumn("rung", rung).where("rung is not null").withColumn("first", F.row_number().over(best))
    found = found.where("rung = 0 or first = 1").select("headword", "part", "form", (F.col("rung") == 0).alias("exact")).distinct()
    every = verbs.select("headword").distinct().select("headword", F.explode(F.array(*map(F.lit, parts))).alias("part"))
    return every.join(found, ["headword", "part"], "left").select("headword", "part", "form", F.coalesce("exact", F.lit(False)).alias("exact"))


def of_kind(words: DataFrame, analyses: DataFrame, verbs: bool) -> DataFrame:
    """words (column word) that some analysis makes a verb, or a noun or adjective."""
    fits = (is_verb if verbs else is_noun)(F.col("analysis"), lemmatized=False)
    return words.join(analyses.where(fits).select(F.col("form").alias("word")).distinct(), "word", "left_semi")

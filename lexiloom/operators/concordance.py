"""Concordances, indices by headword, vocabularies. A word's loci are gathered by work, so no row grows with the corpus; its count over
all works stands beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.interim import written

UNPARSED = "•••unparsed•••"


def words(lines: DataFrame, form=F.lower) -> DataFrame:
    """work_id, idx, word of every token."""
    return lines.select("work_id", "idx", F.explode(T.index_tokens(form("line"))).alias("word"))


def by_word(tokens: DataFrame) -> DataFrame:
    """word, work_id, n, total, loci: the lines of each word in each work, in order, and the word's count over all works. No row gathers
    more than one work has, however common the word; totals are joined from counts that were summed before any shuffle."""
    tokens_of = tokens.groupBy("word", "work_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("idx")), lambda i: i.cast("string")), ", ").alias("loci"))
    one = written(tokens_of, "concordance")
    total = written(one.groupBy("word").agg(F.sum("n").alias("total")), "concordance_totals")
    return one.join(total, "word").select("word", "work_id", "n", "total", "loci")


def word_counts(tokens: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return tokens.groupBy("word", *keys).agg(F.count("*").alias("n"))


def suffix_forms(vocabulary: DataFrame, suffixes: tuple[str, ...] = ("s", "es", "ed", "ing")) -> DataFrame:
    """form, headword: every word is a form of itself, and of its stem where a suffix can go and three letters stay. Several stems
    make a form ambiguous."""
    stems = [F.when(F.endswith("word", F.lit(s)) & (F.char_length("word") >= len(s) + 3), F.substring(F.col("word"), F.lit(1), F.char_length("word") - len(s))) for s in suffixes]
    found = F.filter(F.array(*stems), lambda x: x.isNotNull())
    return vocabulary.select(F.col("word").alias("form"), F.explode(F.array_distinct(F.concat(F.array("word"), found))).alias("headword"))


def possible_forms(headword: str, suffixes: tuple[str, ...] = ("s", "es", "ed", "ing")) -> list[str]:
    """What could be a form of a headword: as many as there are suffixes, and itself."""
    return [headword, *(headword + x for x in suffixes if len(headword) >= 3)]


def forms_of_headword(words: DataFrame, headword: str, suffixes: tuple[str, ...] = ("s", "es", "ed", "ing")) -> DataFrame:
    """form, headword for one headword, out of all words: what can't be a form of it goes before anything is shuffled."""
    likely = words.where(F.col("word").isin(possible_forms(headword, suffixes))).select("word").distinct()
    return suffix_forms(likely, suffixes).where(F.col("headword") == headword)


def by_headword(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """headword, form, n, homonyms: how many headwords a form may belong to; forms without any go to a bucket of their own."""
    many = forms.groupBy("form").agg(F.count("*").alias("homonyms"))
    rows = counts.withColumnRenamed("word", "form").join(forms, "form", "left").join(many, "form", "left")
    return rows.select(F.coalesce("headword", F.lit(UNPARSED)).alias("headword"), "form", "n", F.coalesce("homonyms", F.lit(0)).alias("homonyms"))


def headword_totals(rows: DataFrame) -> DataFrame:
    """Per headword its forms in order and their total. Unparsed forms, which may be most of a vocabulary, have a row each and sort last."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("form", "n"))), lambda x: F.concat(x["form"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    alone = F.when(F.col("headword") == UNPARSED, F.col("form"))
    return rows.groupBy("headword", alone.alias("alone")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"), listed.alias("listing")).drop("alone").withColumn("last", F.col("headword") == UNPARSED)


def vocabulary(tokens: DataFrame, forms: DataFrame, glosses: DataFrame | None = None) -> DataFrame:
    """headword and form_possibilities: distinct forms that may belong to it, each once whatever its count; with a gloss where given."""
    rows = tokens.select(F.col("word").alias("form")).distinct().join(forms, "form").groupBy("headword").agg(F.count("*").alias("form_possibilities"))
    return rows if glosses is None else rows.join(glosses, "headword", "left")

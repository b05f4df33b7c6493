"""Catalog look-ups, vocabularies over them, and what surrounds hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concordance as C
from ..operators import scope as P
from ..operators import search as S
from ..operators import vectors as V
from ..registry import query
from ..sources import corpus
from .searching import FORMS, HIT, WORD, all_forms
from .sql import CATALOG, LINES, TOKENS, fold
from .statistics import tokens
from .texts import SENTENCES


@query("SELECT p_name AS entry, 1 AS dictionary FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT DISTINCT n_name, 2 FROM nation WHERE n_name NOT IN (SELECT p_name FROM part)")
def union_of_lexica(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries as one; where both have an entry the first wins."""
    a = corpus.table(spark, sf, "part").select(F.col("p_name").alias("entry"), F.lit(1).alias("dictionary"))
    b = corpus.table(spark, sf, "nation").select(F.col("n_name").alias("entry"), F.lit(2).alias("dictionary"))
    return a.unionByName(b).groupBy("entry").agg(F.min("dictionary").alias("dictionary"))


@query(f"WITH {LINES}, wanted(work_id, idx) AS (VALUES (1, 1), (2, 3), (7, 2), (7, 2), (99999, 1)) SELECT l.work_id, l.idx, l.line FROM lines l WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.work_id = l.work_id AND w.idx = l.idx)")
def lines_by_key(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(1, 1), (2, 3), (7, 2), (7, 2), (99999, 1)], "work_id long, idx int")
    return corpus.lines(corpus.works(spark, sf)).select("work_id", "idx", "line").join(wanted, ["work_id", "idx"], "left_semi")


@query(f"WITH {CATALOG}, r AS (SELECT author, work_id, title, row_number() OVER (PARTITION BY author ORDER BY work_id) AS n FROM catalog) SELECT author, min(work_id) AS first_work, max(CASE WHEN n = 3 THEN work_id END) AS third_work, count(*)::BIGINT AS works FROM r GROUP BY author")
def works_of_author(spark: SparkSession, sf: str) -> DataFrame:
    """First and third work of each author. Ranks are limited before the shuffle as well, so an author sends three ids a task."""
    rows = corpus.works_catalog(spark, sf).select("author", "work_id")
    low = rows.withColumn("n", F.row_number().over(Window.partitionBy("author").orderBy("work_id"))).where("n <= 3")
    low = low.groupBy("author").agg(F.min("work_id").alias("first_work"), F.max(F.when(F.col("n") == 3, F.col("work_id"))).alias("third_work"))
    return rows.groupBy("author").agg(F.count("*").alias("works")).join(low, "author").select("author", "first_work", "third_work", "works")


@query(f"WITH {TOKENS} SELECT author, count(*)::BIGINT AS words, count(DISTINCT work_id)::BIGINT AS works, count(DISTINCT word)::BIGINT AS distinct_words FROM tokens GROUP BY author")
def words_in_author(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf)).select("author", "work_id", F.explode(T.index_tokens(F.col("line"))).alias("word"))
    return lines.groupBy("author").agg(F.count("*").alias("words"), F.count_distinct("work_id").alias("works"), F.count_distinct("word").alias("distinct_words"))


@query(f"WITH {TOKENS} SELECT word, {fold('word')} AS sort_key FROM (SELECT DISTINCT word FROM tokens)")
def distinct_word_set(spark: SparkSession, sf: str) -> DataFrame:
    words = tokens(spark, sf).select("word").distinct()
    return words.select("word", T.fold(F.col("word")).alias("sort_key"))


@query(f"WITH {CATALOG} SELECT corpus, count(*)::BIGINT AS works, count(DISTINCT author)::BIGINT AS authors, count(*) FILTER (WHERE date IS NULL)::BIGINT AS undated FROM catalog GROUP BY corpus")
def completeness_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.works_catalog(spark, sf).groupBy("corpus").agg(F.count("*").alias("works"), F.count_distinct("author").alias("authors"), F.count_if(F.col("date").isNull()).alias("undated"))


@query(f"WITH {TOKENS}, {FORMS}, c AS (SELECT word AS form, count(*) AS n FROM tokens GROUP BY word), h AS (SELECT form, count(*) AS k FROM forms GROUP BY form) SELECT round(sum(CASE WHEN k > 1 THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS of_tokens, round(count(*) FILTER (WHERE k > 1) / count(*), 6)::DOUBLE AS of_forms FROM c JOIN h USING (form)")
def homonym_ratio(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.word_counts(tokens(spark, sf)).withColumnRenamed("word", "form")
    many = all_forms(spark, sf).groupBy("form").agg(F.count("*").alias("k"))
    rows = counts.join(many, "form")
    return rows.agg(F.round(F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("of_tokens"), F.round(F.count_if(F.col("k") > 1) / F.count("*"), 6).alias("of_forms"))


_HEADS = f"WITH {TOKENS}, {FORMS}, c AS (SELECT word AS form, count(*) AS n FROM tokens GROUP BY word), t AS (SELECT headword, sum(n)::BIGINT AS total FROM forms JOIN c USING (form) GROUP BY headword), top AS (SELECT * FROM t WHERE headword NOT IN ('the', 'of') ORDER BY total DESC, headword LIMIT 50) "


def _top_headwords(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = C.word_counts(tokens(spark, sf)).withColumnRenamed("word", "form")
    forms = C.suffix_forms(counts.select(F.col("form").alias("word")))
    totals = forms.join(counts, "form").groupBy("headword").agg(F.sum("n").alias("total"))
    return totals.where(~F.col("headword").isin("the", "of")).orderBy(F.desc("total"), "headword").limit(50), forms


@query(_HEADS + "SELECT headword, total FROM top")
def most_common_headwords(spark: SparkSession, sf: str) -> DataFrame:
    return _top_headwords(spark, sf)[0]


@query(_HEADS + "SELECT DISTINCT form FROM forms WHERE headword IN (SELECT headword FROM top)")
def most_common_forms(spark: SparkSession, sf: str) -> DataFrame:
    top, forms = _top_headwords(spark, sf)
    return forms.join(top, "headword", "left_semi").select("form").distinct()


def _unbracketed(column: str) -> str:
    for a, b in T.BRACKETS.values():
        x, y = (f"\\{c}" if c.isascii() else c for c in (a, b))
        column = f"regexp_replace(regexp_replace(regexp_replace({column}, '{x}[^{y}]*{y}', '', 'g'), '^[^{x}]*{y}', ''), '{x}[^{y}]*$', '')"
    return column


@query(f"WITH {LINES} SELECT work_id, idx, {_unbracketed('line')} AS line FROM lines WHERE regexp_matches(line, '[][(){{}}⟨⟩]')")
def unbracketed_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.lines(corpus.works(spark, sf)).where(F.col("line").rlike(r"[\[\](){}⟨⟩]"))
    return rows.select("work_id", "idx", T.without_bracketed(F.col("line")).alias("line"))


@query(f"WITH {LINES}, h AS (SELECT work_id, idx FROM lines WHERE regexp_matches(lower(line), '(^|\\s)whst(\\s|$)')) SELECT DISTINCT l.work_id, l.idx, l.line FROM h JOIN lines l ON l.work_id = h.work_id AND l.idx BETWEEN h.idx - 2 AND h.idx + 1")
def environs_of_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines around hits, each once; the right end is left out."""
    works = corpus.works(spark, sf)
    hits = S.simple(works, T.term_pattern(" whst ")).select("work_id", "idx")
    near = hits.select("work_id", F.explode(F.sequence(F.col("idx") - 2, F.col("idx") + 1)).alias("idx")).distinct()
    return corpus.lines(works).select("work_id", "idx", "line").join(near, ["work_id", "idx"])


@query(f"WITH {SENTENCES} SELECT work_id, sentence, array_to_string(list_filter(words, lambda w: w NOT IN ('the', 'and', 'of', 'de', 'la')), ' ') AS bag FROM sentences")
def sentences_without_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sentence_words(corpus.works(spark, sf))
    return rows.select("work_id", "sentence", F.array_join(T.without_stop_words(F.col("words"), ["the", "and", "of", "de", "la"]), " ").alias("bag"))


@query(f"WITH {LINES}, s AS (SELECT work_id, idx, unnest(string_split_regex(line, '[.?!·;]')) AS s, generate_subscripts(string_split_regex(line, '[.?!·;]'), 1) AS k FROM lines) SELECT work_id, s AS sentence, min(idx)::INT AS idx, count(*)::BIGINT AS times FROM (SELECT work_id, idx, trim(s, ' ') AS s FROM s) WHERE s <> '' GROUP BY work_id, s")
def sentence_first_locus(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.lines(corpus.works(spark, sf)).select("work_id", "idx", F.explode(T.sentences(F.col("line"))).alias("s"))
    rows = rows.select("work_id", "idx", F.trim("s").alias("sentence")).where("sentence <> ''")
    return rows.groupBy("work_id", "sentence").agg(F.min("idx").alias("idx"), F.count("*").alias("times"))


@query("SELECT source AS author, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source HAVING sum(n_chars) BETWEEN 1000 AND 100000000")
def authors_for_models(spark: SparkSession, sf: str) -> DataFrame:
    """Authors large enough for a model and below the cap."""
    return corpus.works_catalog(spark, sf).groupBy("author").agg(F.sum("size").alias("size")).where("size between 1000 and 100000000")


@query(f"WITH {CATALOG}, d AS (SELECT DISTINCT md5(work_id::VARCHAR) AS d FROM catalog WHERE corpus = 'en'), p AS (SELECT substr(d, 1, 4) AS part, md5(string_agg(d, '' ORDER BY d)) AS p FROM d GROUP BY 1) SELECT md5(string_agg(p, '' ORDER BY part)) AS fingerprint FROM p")
def scope_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return P.fingerprint(corpus.works_catalog(spark, sf).where("corpus = 'en'"), "work_id")


ABBREVIATIONS = {"st": "saint", "nr": "number", "th": "thus", "re": "regarding"}


@query(f"WITH {TOKENS}, m(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ABBREVIATIONS.items()) + ") SELECT work_id, idx, coalesce(b, word) AS word, count(*)::BIGINT AS n FROM tokens LEFT JOIN m ON word = a WHERE len(word) <= 3 GROUP BY ALL")
def expanded_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    known = F.broadcast(spark.createDataFrame(list(ABBREVIATIONS.items()), "word string, full string"))  # a fixed list
    rows = tokens(spark, sf).where(F.char_length("word") <= 3).join(known, "word", "left")
    return rows.groupBy("work_id", "idx", F.coalesce("full", "word").alias("word")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, hits AS (SELECT corpus, author, work_id, idx FROM lines WHERE {HIT}), n AS (SELECT corpus, author, count(*) AS n, count(DISTINCT work_id) AS works FROM hits GROUP BY ALL) SELECT corpus, author, n::BIGINT AS n, works::BIGINT AS works, round(100.0 * n / sum(n) OVER (PARTITION BY corpus), 4)::DOUBLE AS share FROM n")
def hits_by_author(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.simple(corpus.works(spark, sf), WORD)
    rows = hits.groupBy("corpus", "author").agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("works"))
    return rows.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("corpus")), 4))


@query("SELECT user_id, event_type, count(*)::BIGINT AS n, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM events GROUP BY user_id, event_type")
def timeline_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming count's result over the whole table, as a batch."""
    from ..streaming.search import windowed_counts

    return windowed_counts(corpus.table(spark, sf, "events")).withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("string"))


@query("SELECT * FROM (VALUES ('documents', true), ('pages', true), ('part', true), ('no_such_table', false)) v(name, present)")
def available_tables(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.available(spark, sf, ["documents", "pages", "part", "no_such_table"])

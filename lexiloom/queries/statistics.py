"""Concordance and frequency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concordance as C
from ..operators import stats as A
from ..registry import query
from ..sources import corpus
from .searching import FORMS
from .sql import CATALOG, TOKENS

CORPORA = ["de", "en", "es", "fr"]
COUNT_COLUMNS = ["total_count", *(f"{c}_count" for c in CORPORA)]


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf))
    return lines.select("corpus", "work_id", "idx", "line")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return C.words(_tokens(spark, sf))


def corpus_tokens(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as T

    return _tokens(spark, sf).select("corpus", "work_id", F.explode(T.index_tokens(F.col("line"))).alias("word"))


@query(f"WITH {TOKENS}, w AS (SELECT word, work_id, count(*) AS n, string_agg(idx::VARCHAR, ', ' ORDER BY idx) AS l FROM tokens GROUP BY word, work_id) SELECT word, work_id, n::BIGINT AS n, (sum(n) OVER (PARTITION BY word))::BIGINT AS total, l AS loci FROM w")
def concordance_by_word(spark: SparkSession, sf: str) -> DataFrame:
    return C.by_word(tokens(spark, sf))


@query(f"WITH {TOKENS}, {FORMS}, c AS (SELECT word AS form, count(*) AS n FROM tokens GROUP BY word), h AS (SELECT form, count(*) AS homonyms FROM forms GROUP BY form) SELECT headword, form, n::BIGINT AS n, homonyms::BIGINT AS homonyms FROM c JOIN forms USING (form) JOIN h USING (form)")
def concordance_by_headword(spark: SparkSession, sf: str) -> DataFrame:
    words = tokens(spark, sf)
    counts = C.word_counts(words)
    return C.by_headword(counts, C.suffix_forms(counts.select("word")))


@query(f"WITH {TOKENS}, {FORMS}, c AS (SELECT word AS form, count(*) AS n FROM tokens GROUP BY word) SELECT headword, sum(n)::BIGINT AS n, count(*)::BIGINT AS forms, string_agg(form || ' (' || n || ')', ', ' ORDER BY form) AS listing, false AS last FROM c JOIN forms USING (form) GROUP BY headword")
def headword_index(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.word_counts(tokens(spark, sf))
    return C.headword_totals(C.by_headword(counts, C.suffix_forms(counts.select("word"))))


@query(f"WITH {TOKENS}, {FORMS} SELECT headword, count(DISTINCT form)::BIGINT AS form_possibilities FROM forms GROUP BY headword")
def vocabulary_list(spark: SparkSession, sf: str) -> DataFrame:
    words = tokens(spark, sf)
    return C.vocabulary(words, C.suffix_forms(words.select("word").distinct()))


_COUNTS = f"WITH {TOKENS}, counts AS (SELECT word, count(*)::BIGINT AS total_count, " + ", ".join(f"count(*) FILTER (corpus = '{c}')::BIGINT AS {c}_count" for c in CORPORA) + " FROM tokens GROUP BY word)"


@query(_COUNTS + " SELECT * FROM counts")
def form_counts_by_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts_by(corpus_tokens(spark, sf), "corpus", CORPORA)


_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNT_COLUMNS)


@query(_COUNTS + f" SELECT {_SUMS} FROM counts WHERE regexp_matches(word, '[a-z]')")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.totals(A.counts_by(corpus_tokens(spark, sf), "corpus", CORPORA), COUNT_COLUMNS, "[a-z]")


_TOP = "greatest(" + ", ".join(f"{c}_count" for c in CORPORA) + ")"
_WEIGHTS = _COUNTS + f", t AS (SELECT {_SUMS} FROM counts), w AS (SELECT " + ", ".join(f"round({_TOP} / {c}_count, 2) AS {c}_count" for c in CORPORA) + " FROM t)"


@query(_WEIGHTS + " SELECT * FROM w")
def corpus_weights(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.counts_by(corpus_tokens(spark, sf), "corpus", CORPORA)
    columns = [f"{c}_count" for c in CORPORA]
    return A.weights(A.totals(counts, columns), columns)


_RAW = {c: f"counts.{c}_count * w.{c}_count" for c in CORPORA}
_BEST = "greatest(" + ", ".join(_RAW.values()) + ")"
_DIST = _WEIGHTS + ", dist AS (SELECT word, " + ", ".join(f"CASE WHEN {_BEST} > 0 THEN round(100 * {r} / {_BEST}, 2) ELSE 0 END AS {c}_count" for c, r in _RAW.items()) + " FROM counts, w)"


def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.counts_by(corpus_tokens(spark, sf), "corpus", CORPORA)
    columns = [f"{c}_count" for c in CORPORA]
    return A.weighted(counts, A.weights(A.totals(counts, columns), columns), columns)


@query(_DIST + " SELECT * FROM dist")
def weighted_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution(spark, sf)


@query(_DIST + ", long AS (UNPIVOT dist ON de_count, en_count, es_count, fr_count INTO NAME name VALUE value) SELECT word, name, value, (row_number() OVER (PARTITION BY word ORDER BY value DESC, name))::INT AS place FROM long")
def corpus_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return A.ranking(_distribution(spark, sf), [f"{c}_count" for c in CORPORA])


@query(_DIST + " SELECT word, de_count + en_count AS germanic, es_count + fr_count AS romance FROM dist")
def collapsed_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.collapsed(_distribution(spark, sf), {"germanic": ["de_count", "en_count"], "romance": ["es_count", "fr_count"]})


@query(f"WITH {CATALOG}, e AS (SELECT corpus, size, CASE WHEN eff IS NULL OR eff >= 2000 THEN 'unknown' WHEN eff <= -300 THEN 'early' WHEN eff <= 300 THEN 'middle' ELSE 'late' END AS era FROM dated) SELECT corpus, era, count(*)::BIGINT AS works, sum(size)::BIGINT AS size, round(max(sum(size)) OVER (PARTITION BY corpus) / sum(size), 2)::DOUBLE AS weight FROM e GROUP BY corpus, era")
def era_weights(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    catalog = corpus.works_catalog(spark, sf)
    rows = catalog.join(corpus.authors(catalog), "author", "left").select("corpus", "size", A.era(F.coalesce("date", "author_date")).alias("era"))
    sums = rows.groupBy("corpus", "era").agg(F.count("*").alias("works"), F.sum("size").alias("size"))
    return sums.withColumn("weight", F.round(F.max("size").over(Window.partitionBy("corpus")) / F.col("size"), 2))


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word) SELECT word, n FROM c WHERE word NOT IN ('the', 'and', 'of') ORDER BY n DESC, word LIMIT 100")
def most_common_words(spark: SparkSession, sf: str) -> DataFrame:
    return A.most_common(C.word_counts(tokens(spark, sf)), 100, ["the", "and", "of"])


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word) SELECT floor(log10(n))::INT AS class, count(*)::BIGINT AS words, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def frequency_classes(spark: SparkSession, sf: str) -> DataFrame:
    return A.frequency_class(C.word_counts(tokens(spark, sf))).groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


_ERA = "CASE WHEN eff IS NULL OR eff >= 2000 THEN 'unknown' WHEN eff <= -300 THEN 'early' WHEN eff <= 300 THEN 'middle' ELSE 'late' END"
ERAS = ["early", "middle", "late"]
_ERA_COUNTS = f"WITH {TOKENS}, {CATALOG}, eras AS (SELECT work_id, {_ERA} AS era FROM dated), by_era AS (SELECT word, count(*)::BIGINT AS total_count, " + ", ".join(f"count(*) FILTER (era = '{e}')::BIGINT AS {e}_count" for e in ERAS) + " FROM tokens JOIN eras USING (work_id) GROUP BY word)"
_ERA_COLUMNS = [f"{e}_count" for e in ERAS]


def _era_counts(spark: SparkSession, sf: str) -> DataFrame:
    """word, total and counts by era; what lies in no era is in the total only."""
    catalog = corpus.works_catalog(spark, sf)
    eras = catalog.join(corpus.authors(catalog), "author", "left").select("work_id", A.era(F.coalesce("date", "author_date")).alias("era"))
    return A.counts_by(tokens(spark, sf).select("word", "work_id").join(eras, "work_id"), "era", ERAS)


@query(_ERA_COUNTS + " SELECT *, total_count - early_count - middle_count - late_count AS unknown_count FROM by_era")
def era_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _era_counts(spark, sf).withColumn("unknown_count", A.unknown_era(F.col("total_count"), [F.col(c) for c in _ERA_COLUMNS]))


@query(_ERA_COUNTS + " SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _ERA_COLUMNS) + " FROM by_era WHERE regexp_matches(word, '[a-z]')")
def era_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.totals(_era_counts(spark, sf), _ERA_COLUMNS, "[a-z]")


_ERA_WEIGHTS = _ERA_COUNTS + ", t AS (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in _ERA_COLUMNS) + " FROM by_era), ew AS (SELECT " + ", ".join(f"round(late_count / {c}, 2) AS {c}" for c in _ERA_COLUMNS) + " FROM t)"


@query(_ERA_WEIGHTS + " SELECT * FROM ew")
def word_count_era_weights(spark: SparkSession, sf: str) -> DataFrame:
    return A.weights_to(A.totals(_era_counts(spark, sf), _ERA_COLUMNS), _ERA_COLUMNS, "late_count")


_ERA_RAW = {c: f"by_era.{c} * ew.{c}" for c in _ERA_COLUMNS}
_ERA_BEST = "greatest(" + ", ".join(_ERA_RAW.values()) + ")"


@query(_ERA_WEIGHTS + " SELECT word, " + ", ".join(f"CASE WHEN regexp_matches(word, '^[a-z]+$') THEN CASE WHEN {_ERA_BEST} > 0 THEN round(100 * {r} / {_ERA_BEST}, 2) ELSE 0 END END AS {c}" for c, r in _ERA_RAW.items()) + " FROM by_era, ew")
def weighted_chronology(spark: SparkSession, sf: str) -> DataFrame:
    """Only words of plain letters have a chronology here."""
    counts = _era_counts(spark, sf)
    weights = A.weights_to(A.totals(counts, _ERA_COLUMNS), _ERA_COLUMNS, "late_count")
    return A.weighted_of_script(A.weighted(counts, weights, _ERA_COLUMNS), _ERA_COLUMNS, "^[a-z]+$")


GENRES = ["epic", "hist", "phil", "comic"]
_SIZES = f"WITH {TOKENS}, {CATALOG}, sizes AS (SELECT work_id, count(*) AS n FROM tokens GROUP BY work_id), sized AS (SELECT c.*, coalesce(n, 0) AS n FROM catalog c LEFT JOIN sizes USING (work_id))"
_GENRE = "CASE WHEN genre LIKE '%epic%' THEN 'epic' WHEN genre LIKE '%hist%' THEN 'hist' ELSE 'phil' END"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows with the number of their words."""
    sizes = tokens(spark, sf).groupBy("work_id").agg(F.count("*").alias("n"))
    return corpus.works_catalog(spark, sf).join(sizes, "work_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _genre():
    return F.when(F.contains("genre", F.lit("epic")), "epic").when(F.contains("genre", F.lit("hist")), "hist").otherwise("phil")


@query(_SIZES + " SELECT " + ", ".join(f"coalesce(sum(n) FILTER (genre LIKE '%{g}%' AND corpus IN ('en', 'fr')), 0)::BIGINT AS {g}" for g in GENRES) + " FROM sized")
def genre_word_totals(spark: SparkSession, sf: str) -> DataFrame:
    fits = {g: F.contains("genre", F.lit(g)) & F.col("corpus").isin("en", "fr") for g in GENRES}
    return A.conditional_sums(_sized(spark, sf), "n", fits)


_GW = f"totals AS (SELECT {_GENRE} AS genre, sum(n) AS n FROM sized GROUP BY 1), gw AS (SELECT genre, round((SELECT max(n) FROM totals) / n, 2) AS weight, false AS grouped FROM totals WHERE n > 0 UNION ALL SELECT 'prose', round((SELECT max(n) FROM totals) / sum(n), 2), true FROM totals WHERE genre IN ('hist', 'phil') HAVING sum(n) > 0)"


def _genre_weights(spark: SparkSession, sf: str) -> DataFrame:
    totals = _sized(spark, sf).groupBy(_genre().alias("genre")).agg(F.sum("n").alias("n"))
    none = totals.sparkSession.createDataFrame([("comic", 0)], "genre string, n long")
    return A.genre_weights(totals.unionByName(none), {"prose": ["hist", "phil"]})


@query(f"{_SIZES}, {_GW} SELECT * FROM gw")
def genre_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _genre_weights(spark, sf)


_HEADED = f"{_SIZES}, {_GW}, {FORMS}, counted AS (SELECT headword AS word, genre, count(*) AS n FROM (SELECT word AS form, {_GENRE} AS genre FROM tokens JOIN catalog USING (work_id)) t JOIN forms USING (form) GROUP BY ALL)"


def _headword_genres(spark: SparkSession, sf: str) -> DataFrame:
    """word (a headword), genre, n: every form counts for each headword it may belong to."""
    genres = corpus.works_catalog(spark, sf).select("work_id", _genre().alias("genre"))
    counts = tokens(spark, sf).select("work_id", "word").join(genres, "work_id").groupBy("word", "genre").agg(F.count("*").alias("n"))
    forms = C.suffix_forms(counts.select("word").distinct())
    return counts.withColumnRenamed("word", "form").join(forms, "form").groupBy(F.col("headword").alias("word"), "genre").agg(F.sum("n").alias("n"))


@query(_HEADED + ", t AS (SELECT genre, sum(n) AS n FROM counted GROUP BY genre) SELECT genre, round((SELECT max(n) FROM t) / n, 2) AS weight, false AS grouped FROM t")
def genre_weights_of_headwords(spark: SparkSession, sf: str) -> DataFrame:
    return A.genre_weights(_headword_genres(spark, sf).groupBy("genre").agg(F.sum("n").alias("n")))


_RANKED = ", k AS (SELECT c.word, c.genre, c.n * g.weight AS raw FROM counted c JOIN (SELECT * FROM gw WHERE NOT grouped AND weight < {most}) g USING (genre)), v AS (SELECT word, genre, round(100 * raw / max(raw) OVER (PARTITION BY word), 4) AS value FROM k) SELECT *, (row_number() OVER (PARTITION BY word ORDER BY value DESC, genre))::INT AS place FROM v"


@query(_HEADED + _RANKED.format(most="1.05"))
def genre_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Headwords by genre, without the genres whose weight is 1.05 or more."""
    return A.genre_ranking(_headword_genres(spark, sf), A.without_minor(_genre_weights(spark, sf).where("not grouped"), 1.05))


@query(_COUNTS + " SELECT word, concat_ws(' / ', " + ", ".join(f"CASE WHEN {c}_count > 0 THEN '{c} ' || {c}_count END" for c in CORPORA) + f", CASE WHEN total_count <> {_TOP} THEN 'total ' || total_count END) AS prevalence FROM counts")
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.counts_by(corpus_tokens(spark, sf), "corpus", CORPORA)
    return counts.select("word", A.prevalence(F.col("total_count"), {c: F.col(f"{c}_count") for c in CORPORA}).alias("prevalence"))


@query(_COUNTS + " SELECT word, total_count FROM counts WHERE word IN ('the', 'of', 'zzz')")
def counts_of_headwords(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of some words: the filter goes before the counting."""
    rows = corpus_tokens(spark, sf).where(F.col("word").isin("the", "of", "zzz"))
    return A.counts_by(rows, "corpus", CORPORA).select("word", "total_count")

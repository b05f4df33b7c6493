"""Vector analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concordance as C
from ..operators import morphology as M
from ..operators import upkeep as U
from ..operators import vectors as V
from ..operators.plane import in_the_plane
from ..operators.skipgram import skip_gram
from ..registry import query
from ..sources import corpus, interim, models
from ..sources.postings import digest
from .searching import FORMS
from .sql import index_words
from .texts import SENTENCES

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _one(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    """One vector, by its id."""
    return list(corpus.table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


@query(f"SELECT b.vec_id, round({_COS}, 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND round({_COS}, 4) > 0.15 ORDER BY similarity DESC, b.vec_id LIMIT 25")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return V.nearest(corpus.table(spark, sf, "embeddings"), _one(spark, sf, 3), 25, 0.15, without=[3])


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.table(spark, sf, "embeddings")
    a = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    b = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 4).alias("similarity"))


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


@query(f"WITH u AS (SELECT vec_id, embedding, {_UNIT} AS v FROM embeddings), t AS (SELECT list_transform(list_zip(p.v, q.v, m.v), lambda z: z[1] + z[2] - z[3]) AS t FROM u p, u q, u m WHERE p.vec_id = 1 AND q.vec_id = 2 AND m.vec_id = 4) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], t), 4) AS similarity FROM u, t WHERE vec_id NOT IN (1, 2, 4) ORDER BY similarity DESC, vec_id LIMIT 4")
def analogy(spark: SparkSession, sf: str) -> DataFrame:
    return V.analogy(corpus.table(spark, sf, "embeddings"), [_one(spark, sf, 1), _one(spark, sf, 2)], [_one(spark, sf, 4)], 4, [1, 2, 4])


@query(f"WITH kept AS (SELECT b.vec_id, round({_COS}, 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND round({_COS}, 4) > 0.15 ORDER BY similarity DESC, b.vec_id LIMIT 20), e AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM kept)) SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 4) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round({_COS}, 4) >= 0.2")
def neighbour_edges(spark: SparkSession, sf: str) -> DataFrame:
    vectors = corpus.table(spark, sf, "embeddings")
    return V.neighbour_edges(vectors, V.nearest(vectors, _one(spark, sf, 3), 20, 0.15), 0.2)


@query(f"WITH {SENTENCES}, c AS (SELECT work_id, sentence, w AS word, count(*) AS n FROM (SELECT work_id, sentence, unnest(words) AS w FROM sentences) GROUP BY ALL), m AS (SELECT work_id, sentence, n AS f FROM c WHERE word = 'the'), s AS (SELECT word, sum(n * f)::BIGINT AS together FROM c JOIN m USING (work_id, sentence) GROUP BY word), l AS (SELECT word, sum(n * n) AS square FROM c GROUP BY word) SELECT word, together, round(together / sqrt(square * (SELECT sum(f * f) FROM m)::DOUBLE), 6) AS cosine FROM s JOIN l USING (word) WHERE word <> 'the'")
def cooccurrence_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return V.cooccurrence(V.sentence_words(corpus.works(spark, sf)), "the")


def _bags(spark: SparkSession, sf: str, method: str) -> DataFrame:
    sentences = V.sentence_words(corpus.works(spark, sf))
    counts = interim.written(sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    forms = C.suffix_forms(counts.select("word"))
    totals = forms.join(counts.withColumnRenamed("word", "form"), "form").groupBy("headword").agg(F.sum("n").alias("total"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return V.bags(sentences, forms, totals, method, stops=["the", "and"], size=size)


_BAGS = f"""WITH {SENTENCES}, tokens AS (SELECT work_id, sentence, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM sentences), {FORMS},
totals AS (SELECT headword, sum(n) AS total FROM forms JOIN (SELECT word AS form, count(*) AS n FROM tokens GROUP BY word) USING (form) GROUP BY headword),
choice AS (SELECT form, list(headword ORDER BY headword) AS heads, first(headword ORDER BY total DESC, headword) AS best FROM forms JOIN totals USING (headword) GROUP BY form),
rows_ AS (SELECT work_id, sentence, pos, heads, best FROM tokens JOIN choice ON word = form WHERE NOT list_has_any(heads, ['the', 'and']))
SELECT work_id, sentence, string_agg(@BAG, ' ' ORDER BY pos) AS bag FROM rows_ GROUP BY work_id, sentence"""


@query(_BAGS.replace("@BAG", "array_to_string(heads, ' ')"))
def sentence_bags_flat(spark: SparkSession, sf: str) -> DataFrame:
    return _bags(spark, sf, "flat")


@query(_BAGS.replace("@BAG", "array_to_string(heads, '·')"))
def sentence_bags_alternates(spark: SparkSession, sf: str) -> DataFrame:
    return _bags(spark, sf, "alternates")


@query(_BAGS.replace("@BAG", "best"))
def sentence_bags_winner(spark: SparkSession, sf: str) -> DataFrame:
    return _bags(spark, sf, "winner")


_WORDS = index_words("replace(text, chr(10), ' ')")
_TFIDF = f"""WITH docs AS (SELECT doc_id AS id, {_WORDS} AS ws FROM documents UNION ALL SELECT -1 - item_id, {_WORDS} FROM benchmark),
tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(ws) AS word FROM docs) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
w AS (SELECT id, word, tf * ln((SELECT count(*) FROM docs) / df) AS w FROM tf JOIN df USING (word)), l AS (SELECT id, sqrt(sum(w * w)) AS n FROM w WHERE w > 0 GROUP BY id),
u AS (SELECT id, word, w / n AS w FROM w JOIN l USING (id) WHERE w > 0)
SELECT -1 - q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), 4) AS similarity FROM u q JOIN u d USING (word) WHERE q.id < 0 AND d.id >= 0 GROUP BY ALL HAVING sum(q.w * d.w) >= 0.2"""


@query(_TFIDF)
def tfidf_pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = corpus.table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    words = T.index_tokens(F.translate("text", "\n", " "))
    weights = V.tfidf(docs.unionByName(items), "id", words)
    pairs = V.best_tfidf_matches(weights.where("id < 0"), weights.where("id >= 0"), 0.2)
    return pairs.select((-1 - F.col("query")).alias("item_id"), F.col("doc").alias("doc_id"), F.round("similarity", 4).alias("similarity"))


#: What a model of words is made with.
SKIPGRAM = {"size": 300, "window": 10, "least": 10, "passes": 12}


@query()
def word2vec_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of a word in a model of the corpus, which is fitted once and found again by a digest of its works' texts. More words than a model may be made
    of are refused, as the search form does."""
    works = corpus.works(spark, sf)
    sentences = V.sentence_words(works)
    size = sentences.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    texts = works.select("work_id", F.xxhash64("lines").alias("h")).agg(digest("work_id", "h")).first()[0]
    path = models.path(interim.folder(spark), models.fingerprint([texts], "skip-gram", **SKIPGRAM))
    if V.refusal(size, ["the"], {"the"}) is None and not interim.exists(spark, f"{path}/_SUCCESS"):
        skip_gram(sentences, ["work_id", "sentence"], **SKIPGRAM).write.mode("overwrite").parquet(path)
    vectors = spark.read.parquet(path) if interim.exists(spark, f"{path}/_SUCCESS") else spark.createDataFrame([], "word string, embedding array<float>")
    return V.neighbours_of_terms(vectors, ["the"], 25).select(F.col("b").alias("word"), "similarity")


@query()
def lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    sentences = V.bundled(corpus.works(spark, sf), 5)
    return V.topics(sentences)


def _worded(spark: SparkSession, sf: str) -> DataFrame:
    works = corpus.works(spark, sf)
    return works.select(F.col("work_id").alias("id"), T.index_tokens(F.array_join("lines", " ")).alias("words"))


@query()
def latent_space(spark: SparkSession, sf: str) -> DataFrame:
    return V.latent_space(_worded(spark, sf)).withColumnRenamed("id", "work_id")


@query()
def latent_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Works in two dimensions, for a map of them: those that use the same words lie side by side."""
    return in_the_plane(V.latent_space(_worded(spark, sf))).withColumnRenamed("id", "work_id")


@query()
def lsi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Works by their likeness to a few words along the axes of the largest singular values."""
    return V.lsi(_worded(spark, sf), ["the", "of", "and"]).select(F.col("id").alias("work_id"), F.round("similarity", 6).alias("similarity"))


_UPKEEP = """words AS (SELECT lang, source, doc_id, len(list_filter(string_split(replace(replace(text, chr(10), ' '), chr(160), ' '), ' '), lambda w: w <> '')) AS n FROM documents),
lists AS (SELECT 'author' AS kind, source AS name, sum(n)::BIGINT AS words, max((doc_id IN (5, 17, 23))::INT) AS changed, max((lang = 'en')::INT) AS english FROM words GROUP BY source
  UNION ALL SELECT 'corpus', lang, sum(n)::BIGINT, max((doc_id IN (5, 17, 23))::INT), 0 FROM words GROUP BY lang)"""


@query(f"WITH {_UPKEEP} SELECT kind, name, words, CASE WHEN words < 500 THEN 'small' WHEN words >= 94000000 THEN 'large' WHEN changed = 1 THEN 'due' ELSE 'current' END AS state FROM lists UNION ALL SELECT kind, 'old ' || name, 0, 'gone' FROM lists WHERE english = 1")
def models_due(spark: SparkSession, sf: str) -> DataFrame:
    """What the keeper of models has to do where its register was made before three works came and some authors got other names."""
    works = corpus.works(spark, sf)
    then = U.worklist(works.where(~F.col("work_id").isin(5, 17, 23)))
    left = U.worklist(works.where("corpus = 'en'")).where("kind = 'author'").withColumn("name", F.concat(F.lit("old "), "name"))
    register = then.unionByName(left).select("kind", "name", "digest", F.lit("{}").alias("parameters"), F.lit("").alias("path"))
    return U.states(U.worklist(works), register, "{}").select("kind", "name", "words", "state")


_LIKE = "(1 + list_cosine_similarity(embedding::DOUBLE[], {v}.embedding::DOUBLE[])) / 2"


@query(f"WITH p AS (SELECT embedding FROM embeddings WHERE vec_id = 1), q AS (SELECT embedding FROM embeddings WHERE vec_id = 2), m AS (SELECT embedding FROM embeddings WHERE vec_id = 4) SELECT e.vec_id, round(({_LIKE.format(v='p').replace('(embedding', '(e.embedding')}) * ({_LIKE.format(v='q').replace('(embedding', '(e.embedding')}) / (({_LIKE.format(v='m').replace('(embedding', '(e.embedding')}) + 1e-6), 4) AS score FROM embeddings e, p, q, m WHERE vec_id NOT IN (1, 2, 4) ORDER BY score DESC, vec_id LIMIT 5")
def multiplied_analogy(spark: SparkSession, sf: str) -> DataFrame:
    return V.multiplied_analogy(corpus.table(spark, sf, "embeddings"), [_one(spark, sf, 1), _one(spark, sf, 2)], [_one(spark, sf, 4)], 5, [1, 2, 4])


_NAMED = "named AS (SELECT 'v' || vec_id AS word, embedding FROM embeddings)"


@query(f"WITH {_NAMED}, n AS (SELECT a.word AS a, b.word AS b, round({_COS}, 4) AS similarity FROM named a, named b WHERE a.word <> b.word AND a.word IN ('v3', 'v5') AND round({_COS}, 4) > 0.15), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM n) SELECT a, b, similarity FROM r WHERE k <= 10 UNION ALL SELECT a.word, b.word, round({_COS}, 4) FROM named a, named b WHERE a.word = 'v1' AND b.word = 'v2'")
def neighbours_of_terms(spark: SparkSession, sf: str) -> DataFrame:
    """One term, one with a capital, two terms, and an unknown one."""
    vectors, found = corpus.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), "embedding"), None
    for terms in (["v3"], ["V5"], ["v1", "V2"], ["nothing"]):
        rows = V.neighbours_of_terms(vectors, terms, 10)
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"WITH {_NAMED} SELECT b.word, round({_COS}, 4) AS similarity FROM named a, named b WHERE a.word = 'v3' AND b.word <> 'v3' AND round({_COS}, 4) > 0.15 AND right(b.word, 1) = '7' ORDER BY similarity DESC, b.word")
def neighbours_by_part_of_speech(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours that some analysis makes a verb: here those whose name ends in 7 have a finite form's."""
    vectors = corpus.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), "embedding")
    analyses = vectors.select(F.col("word").alias("form"), F.when(F.endswith("word", F.lit("7")), "pres ind act 3rd sg").otherwise("neut nom sg").alias("analysis"))
    near = V.neighbours_of_terms(vectors, ["v3"], k=1 << 30).select(F.col("b").alias("word"), "similarity")
    return M.of_kind(near, analyses, verbs=True)


_MARKED = """marked AS (SELECT doc_id AS work_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: '⊏' || i || '⊐' || l), ' ') AS t FROM documents),
cut AS (SELECT work_id, unnest(string_split_regex(t, '[.?!·;]')) AS raw, (generate_subscripts(string_split_regex(t, '[.?!·;]'), 1) - 1)::INT AS pos FROM marked),
told AS (SELECT work_id, pos, trim(regexp_replace(raw, '⊏\\d+⊐', '', 'g'), ' ') AS text, regexp_extract(raw, '^\\s*⊏(\\d+)⊐', 1) AS own, regexp_extract_all(raw, '⊏(\\d+)⊐', 1)[-1] AS last FROM cut),
loci AS (SELECT work_id, pos AS sentence, text, coalesce(nullif(own, ''), last_value(last IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS idx FROM told)"""


@query(f"WITH {_MARKED} SELECT work_id, sentence, text, idx FROM loci WHERE text <> ''")
def sentence_loci(spark: SparkSession, sf: str) -> DataFrame:
    return V.sentence_loci(corpus.works(spark, sf))


@query(rf"WITH {_MARKED} SELECT work_id, sentence, text, idx FROM loci WHERE text <> '' AND regexp_matches(lower(text), '(^|\s)whst(\s|$)')")
def sentences_with_term(spark: SparkSession, sf: str) -> DataFrame:
    return V.sentence_loci(corpus.works(spark, sf), T.term_pattern(" whst "))


@query("WITH lines AS (SELECT doc_id AS work_id, trim(unnest(string_split(text, chr(10))), ' ') AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS idx FROM documents) SELECT text, work_id, idx FROM lines WHERE text <> '' AND text IN (SELECT text FROM lines WHERE work_id % 2 = 1)")
def lines_of_sentences(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf)).select("work_id", "idx", "line")
    return V.lines_of_sentences(lines.where("work_id % 2 = 1").select(F.col("line").alias("text")), lines)


_OWN = f"""WITH tf AS (SELECT doc_id AS id, word, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
w AS (SELECT id, word, tf * ln((SELECT count(*) FROM documents) / df) AS w FROM tf JOIN df USING (word)), l AS (SELECT id, sqrt(sum(w * w)) AS n FROM w WHERE w > 0 GROUP BY id),
u AS (SELECT id, word, w / n AS w FROM w JOIN l USING (id) WHERE w > 0), s AS (SELECT q.id AS a, d.id AS b, sum(q.w * d.w) AS similarity FROM u q JOIN u d ON q.word = d.word AND q.id < d.id GROUP BY ALL HAVING sum(q.w * d.w) >= 0.6)"""


def _own_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.table(spark, sf, "documents")
    return V.tfidf(docs.select(F.col("doc_id").alias("id"), "text"), "id", T.index_tokens(F.translate("text", "\n", " ")))


@query(_OWN + " SELECT a, b, round(similarity, 4) AS similarity FROM s")
def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    return V.similar_documents(_own_weights(spark, sf), 0.6).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(_OWN + ", both_ AS (SELECT a AS query, b AS doc, round(similarity, 4) AS similarity FROM s UNION ALL SELECT b, a, round(similarity, 4) FROM s), k AS (SELECT x.*, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS place FROM both_ x JOIN documents q ON q.doc_id = query JOIN documents d ON d.doc_id = doc WHERE q.source <> d.source) SELECT query, doc, similarity, place::INT AS place FROM k WHERE place <= 3")
def likest_of_other_authors(spark: SparkSession, sf: str) -> DataFrame:
    weights = _own_weights(spark, sf)
    pairs = V.best_tfidf_matches(weights, weights, 0.6).where("query <> doc").withColumn("similarity", F.round("similarity", 4))
    authors = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return V.best_of_each(pairs, 3, (authors, "source"))

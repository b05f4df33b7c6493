"""Vector analytics: bags of words from sentences, similarity, neighbours, analogies, and Spark ML models of words and topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from ..sources.interim import written
from .singular import truncated


#: Forms whose choice of headwords is broadcast (about 100 bytes each); beyond, words are joined by shuffle.
MOST_BROADCAST_FORMS = 500_000


def sentence_words(works: DataFrame) -> DataFrame:
    """work_id, sentence (from 1), words: a work's lines joined, cut at sentence ends, folded, punctuation off, empty ones gone."""
    text = T.vector_clean(F.array_join("lines", " "))
    words = F.transform(T.sentences(text), lambda s: T.tokens(F.regexp_replace(s, r"[\p{P}\p{S}]", "")))
    rows = works.select("work_id", F.posexplode(F.filter(words, lambda w: F.size(w) > 0)).alias("pos", "words"))
    return rows.select("work_id", (F.col("pos") + 1).alias("sentence"), "words")


def bundled(works: DataFrame, size: int) -> DataFrame:
    """Each work's sentences in bundles of `size`, the remainder dropped."""
    text = T.vector_clean(F.array_join("lines", " "))
    words = F.filter(F.transform(T.sentences(text), lambda s: T.tokens(F.regexp_replace(s, r"[\p{P}\p{S}]", ""))), lambda w: F.size(w) > 0)
    rows = works.select("work_id", words.alias("all"))
    count = F.floor(F.size("all") / size).cast("int")
    rows = rows.where(count > 0).select("work_id", "all", F.explode(F.sequence(F.lit(1), count)).alias("bundle"))
    return rows.select("work_id", "bundle", F.flatten(F.slice("all", (F.col("bundle") - 1) * size + 1, F.lit(size))).alias("words"))


def bags(sentences: DataFrame, forms: DataFrame, totals: DataFrame, method: str, stops: list[str] = (), size: int | None = None) -> DataFrame:
    """work_id, sentence, bag. flat: all headwords a word may belong to; alternates: they are joined by a middle dot; winner: the one
    counted most often (ties by the alphabet); plain: the words. A word any of whose headwords is a stop word goes. What a form becomes
    is settled once for each form and broadcast up to MOST_BROADCAST_FORMS of them, so that words are not shuffled by form; beyond, each
    part of the works gets its own forms. size: how many words the sentences have, where that is known."""
    if method == "plain":
        kept = F.filter("words", lambda w: ~w.isin(*stops)) if stops else F.col("words")
        return sentences.select("work_id", "sentence", F.array_join(kept, " ").alias("bag"))
    ranked = forms.join(totals, "headword", "left").select("form", "headword", F.coalesce("total", F.lit(0)).alias("total"))
    choice = written(ranked.groupBy("form").agg(F.sort_array(F.collect_set("headword")).alias("heads"), F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "headword")))[0]["headword"].alias("best")), "form_choice")
    heads = F.coalesce("heads", F.array("form"))
    word = {"flat": F.array_join(heads, " "), "alternates": F.array_join(heads, "·"), "winner": F.coalesce("best", "form")}[method]
    gone = F.arrays_overlap(heads, F.array(*map(F.lit, stops))) if stops else F.lit(False)
    if choice.count() <= MOST_BROADCAST_FORMS:
        return _bags_in_place(sentences, choice.select("form", F.when(~gone, word).alias("word")), stops)
    return _bags_by_parts(sentences, choice.select("form", F.when(~gone, word).alias("word")), stops, size)


#: Words of a part, about, that are looked up together where there are too many forms to broadcast.
PART_WORDS = 1_000_000


def _replaced(column, known: dict, none: frozenset) -> list[str | None]:
    """The bag of each list of words; None where no word is left."""
    return [" ".join(kept) if ws is not None and (kept := [x for w in ws if (x := known.get(w, None if w in none else w)) is not None]) else None for ws in column]


def _bags_by_parts(sentences: DataFrame, words: DataFrame, stops: list[str], size: int | None = None) -> DataFrame:
    """words: form and the word that stands for it in a bag (null: none). Works are dealt to parts; a part gets each form that it has once, and replaces its sentences'
    words where they are, so that no word is shuffled as often as it occurs. Words hold no blanks."""
    ship(sentences.sparkSession)
    none = frozenset(stops)
    size = sentences.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] if size is None else size
    parts = max(1, -(-size // PART_WORDS))
    part = F.pmod(F.xxhash64("work_id"), F.lit(parts)).cast("int").alias("part")
    placed = sentences.select("work_id", "sentence", F.array_join("words", " ").alias("words"), part)
    own = sentences.select(part, F.explode("words").alias("form")).distinct().join(words, "form").select(F.col("part").alias("of_part"), "form", "word")

    def bag(key, rows, known):
        import pyarrow as pa

        held = dict(zip(known.column("form").to_pylist(), known.column("word").to_pylist()))
        found = pa.chunked_array([pa.array(_replaced((ws.split(" ") if ws else [] for ws in batch.column("words").to_pylist()), held, none), pa.string()) for batch in rows.to_batches(max_chunksize=4096)], pa.string())
        return pa.table({"work_id": rows.column("work_id"), "sentence": rows.column("sentence"), "bag": found}).filter(found.is_valid())

    kinds = dict(sentences.dtypes)
    return placed.groupBy("part").cogroup(own.groupBy("of_part")).applyInArrow(bag, f"work_id {kinds['work_id']}, sentence {kinds['sentence']}, bag string")


def _bags_in_place(sentences: DataFrame, words: DataFrame, stops: list[str]) -> DataFrame:
    """words: form and the word that stands for it in a bag (null: none). Each sentence's words are replaced where they are: no word is shuffled."""
    spark = sentences.sparkSession
    ship(spark)
    table = words.toArrow()
    held = spark.sparkContext.broadcast(dict(zip(table.column("form").to_pylist(), table.column("word").to_pylist())))
    none = frozenset(stops)

    @F.pandas_udf("string")
    def bag(column: pd.Series) -> pd.Series:
        return pd.Series(_replaced(column, held.value, none), dtype=object)

    return sentences.select("work_id", "sentence", bag("words").alias("bag")).where("bag is not null")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: Column | list[float], k: int, least: float, digits: int = 4, without: list = ()) -> DataFrame:
    """The k rows most like one vector, above a similarity: a scan and a top-k, no shuffle of vectors."""
    q = F.array(*map(F.lit, query)) if isinstance(query, list) else query
    rows = vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), digits).alias("similarity"))
    rows = rows.where(~F.col("vec_id").isin(*without)) if without else rows
    return rows.where(F.col("similarity") > least).orderBy(F.desc("similarity"), "vec_id").limit(k)


def analogy(vectors: DataFrame, plus: list[list[float]], minus: list[list[float]], k: int, without: list) -> DataFrame:
    """Rows nearest to the sum of unit vectors of plus, less those of minus."""
    size = len(plus[0])
    length = lambda v: sum(x * x for x in v) ** 0.5
    target = [sum(v[i] / length(v) for v in plus) - sum(v[i] / length(v) for v in minus) for i in range(size)]
    return nearest(vectors, target, k, -2.0, without=without)


def neighbour_edges(vectors: DataFrame, kept: DataFrame, least: float, digits: int = 4) -> DataFrame:
    """Pairs of a short list of kept rows that are alike: the list is a top-k, so its square is small."""
    rows = vectors.join(F.broadcast(kept.select("vec_id")), "vec_id").select("vec_id", "embedding")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), digits).alias("similarity"))
    return pairs.where(F.col("similarity") >= least)


def cooccurrence(sentences: DataFrame, focus: str) -> DataFrame:
    """word, together, cosine: how often words share a sentence with the focus, and the cosine of their sentence counts. A sentence's words are counted in its own
    row, and words are added up before they are shuffled."""
    row = sentences.select(counted(F.col("words")).alias("all"), F.size(F.filter("words", lambda w: w == focus)).alias("f"))
    n = F.col("x.n").cast("long")
    each = row.select(F.explode("all").alias("x"), "f").select("x.word", (n * n).alias("square"), (n * F.col("f")).alias("together"))
    sums = written(each.groupBy("word").agg(F.sum("together").alias("together"), F.sum("square").alias("square")), "sentence_counts")
    own = sums.where(F.col("word") == focus).select(F.col("square").alias("own"))
    rows = sums.where((F.col("together") > 0) & (F.col("word") != focus)).join(F.broadcast(own))  # one row
    return rows.select("word", "together", F.round(F.col("together") / F.sqrt(F.col("square") * F.col("own").cast("double")), 6).alias("cosine"))


def counted(words: Column) -> Column:
    """array<struct<word, n>> of an array of words: sorted once, then cut where the word changes."""

    def runs(s):
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.get(F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("n")))), F.lit(0))

    return F.when(F.size(words) > 0, F.get(F.transform(F.array(F.array_sort(words)), runs), F.lit(0)))


def tfidf(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """id, word, w: term frequency times ln(N / df), of unit length for each document. Counts and weights are written in between, as
    each is read more than once."""
    tf = written(docs.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf")), "term_counts")
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    rows = tf.join(df, "word").join(F.broadcast(n))  # one row
    rows = rows.select("id", "word", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w")).where("w > 0")
    length = F.sqrt(F.aggregate("all", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    rows = rows.groupBy("id").agg(F.collect_list(F.struct("word", "w")).alias("all")).withColumn("length", length)
    return written(rows.select("id", F.explode("all").alias("x"), "length").select("id", "x.word", (F.col("x.w") / F.col("length")).alias("w")), "term_weights")


#: Documents of a block, about, whose words meet those of another block when candidates are compared.
BLOCK_DOCS = 2000


def _telling(rows: DataFrame, bounds: DataFrame, least: float) -> DataFrame:
    """id, word: a row's words without the commonest, which together can't reach `least`: neither each at its largest weight on the other side (bounds: word, df, most), nor by their
    length, as the other side's is one."""
    common_first = Window.partitionBy("id").orderBy(F.desc("df"), "word").rowsBetween(Window.unboundedPreceding, 0)  # one document's words
    upto = F.least(F.sum(F.col("w") * F.col("most")).over(common_first), F.sqrt(F.sum(F.col("w") * F.col("w")).over(common_first)))
    return rows.join(bounds, "word").withColumn("upto", upto).where(F.col("upto") >= least * (1 - 1e-9)).select("id", "word")


def _compared(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """query, doc, similarity of the pairs that reach `least`, on all words. Pairs are dealt to pairs of blocks, and a pair of blocks gets the words of each document that it has in any pair
    once, however many pairs that are."""
    ship(pairs.sparkSession)
    blocks = max(1, -(-docs.select("id").distinct().count() // BLOCK_DOCS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select("query", "doc", block("query").alias("one"), block("doc").alias("two"))
    ids = placed.select("one", "two", F.col("query").alias("id")).union(placed.select("one", "two", F.col("doc").alias("id"))).distinct()
    whole = docs.groupBy("id").agg(F.collect_list("word").alias("words"), F.collect_list("w").alias("ws"))
    parts = ids.join(whole, "id").select(F.col("one").alias("of_one"), F.col("two").alias("of_two"), "id", "words", "ws")

    def compare(key, pairs, vectors):
        import math

        import pyarrow as pa

        held = {i: dict(zip(words, ws)) for i, words, ws in zip(*(vectors.column(c).to_pylist() for c in ("id", "words", "ws")))}
        found = []
        for q, d in zip(pairs.column("query").to_pylist(), pairs.column("doc").to_pylist()):
            x, y = held[q], held[d]
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            same = math.fsum(w * y[k] for k, w in x.items() if k in y)
            if same >= least:
                found.append((q, d, same))
        q, d, same = zip(*found) if found else ((), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "doc": pa.array(d, pa.int64()), "similarity": pa.array(same, pa.float64())})

    return placed.groupBy("one", "two").cogroup(parts.groupBy("of_one", "of_two")).applyInArrow(compare, "query long, doc long, similarity double")


def best_tfidf_matches(queries: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Pairs of queries and documents by cosine of tf-idf weights (both from tfidf()), at least `least`; of one table with itself each pair both ways, and none of a document with
    itself. Candidates share a telling word of the query (see _telling). Within one table it tells on both sides: words are ordered by how many documents hold them, and the
    rarest that a pair shares is among the telling ones of both. Candidates are then compared on all words."""
    alone = queries is docs
    seen = written(docs.groupBy("word").agg(F.max("w").alias("most"), F.count("*").alias("df")), "word_bounds")
    asked = _telling(queries, seen, least)
    asked = written(asked, "telling_words") if alone else asked
    told = asked if alone else docs
    pairs = asked.withColumnRenamed("id", "query").join(told.select(F.col("id").alias("doc"), F.col("word")), "word")
    pairs = written((pairs.where("query < doc") if alone else pairs).select("query", "doc").distinct(), "tfidf_candidates")
    if not alone:  # short queries: a pair may carry its query's words
        whole = lambda rows, name: rows.groupBy(F.col("id").alias(name)).agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias(f"{name}_words"))
        rows = pairs.join(whole(queries, "query"), "query").join(whole(docs.join(pairs.select(F.col("doc").alias("id")).distinct(), "id", "left_semi"), "doc"), "doc")
        shared = F.array_intersect(F.map_keys("query_words"), F.map_keys("doc_words"))
        total = F.aggregate(shared, F.lit(0.0), lambda s, w: s + F.element_at("query_words", w) * F.element_at("doc_words", w))
        return rows.select("query", "doc", total.alias("similarity")).where(F.col("similarity") >= least)
    found = written(_compared(pairs, docs, least), "tfidf_matches")
    return found.unionByName(found.select(F.col("doc").alias("query"), F.col("query").alias("doc"), "similarity"))


def best_of_each(pairs: DataFrame, k: int, different: tuple[DataFrame, str] | None = None) -> DataFrame:
    """The k likest documents of each query (ties by id); with a table (id, column) only those whose column differs from the query's."""
    if different:
        table, column = different
        of = lambda name: table.select(F.col("id").alias(name), F.col(column).alias(f"{name}_"))
        pairs = pairs.join(of("query"), "query").join(of("doc"), "doc").where("query_ <> doc_").drop("query_", "doc_")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "doc"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def similar_documents(weights: DataFrame, least: float) -> DataFrame:
    """a, b, similarity: pairs of one table's documents, a before b."""
    pairs = best_tfidf_matches(weights, weights, least)
    return pairs.where("query < doc").select(F.col("query").alias("a"), F.col("doc").alias("b"), "similarity")


def multiplied_analogy(vectors: DataFrame, plus: list[list[float]], minus: list[list[float]], k: int, without: list, digits: int = 4) -> DataFrame:
    """Rows by the product of their likeness to plus over that to minus, likeness being (1 + cosine) / 2."""
    like = lambda v: (1 + cosine(F.col("embedding"), F.array(*map(F.lit, v)))) / 2
    score = F.lit(1.0)
    for v in plus:
        score = score * like(v)
    below = F.lit(1.0)
    for v in minus:
        below = below * like(v)
    rows = vectors.where(~F.col("vec_id").isin(*without)) if without else vectors
    return rows.select("vec_id", F.round(score / (below + 1e-6), digits).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def sentence_loci(works: DataFrame, term: str | None = None) -> DataFrame:
    """work_id, sentence, text, idx: sentences over line borders, with the line that each begins in: its own mark if it starts with one, else
    the last one seen before it. With a term (a pattern) only sentences that match."""
    marked = F.array_join(F.transform("lines", lambda line, i: F.concat(F.lit("⊏"), (i + 1).cast("string"), F.lit("⊐"), line)), " ")
    rows = works.select("work_id", F.posexplode(T.sentences(marked)).alias("pos", "raw"))
    marks = F.regexp_extract_all("raw", F.lit("⊏(\\d+)⊐"), F.lit(1))
    rows = rows.select("work_id", "pos", F.trim(F.regexp_replace("raw", r"⊏\d+⊐", "")).alias("text"), F.regexp_extract("raw", r"^\s*⊏(\d+)⊐", 1).alias("own"), F.try_element_at(marks, F.lit(-1)).alias("last"))
    before = Window.partitionBy("work_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a work's sentences
    rows = rows.withColumn("idx", F.coalesce(F.when(F.col("own") != "", F.col("own")), F.last("last", ignorenulls=True).over(before)).cast("int"))
    rows = rows.where("text <> ''").select("work_id", F.col("pos").alias("sentence"), "text", "idx")
    return rows if term is None else rows.where(F.lower("text").rlike(term))


def lines_of_sentences(sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """sentences (column text) with the lines (work_id, idx) that are equal to them but for blanks at the ends."""
    asked = sentences.select(F.trim("text").alias("text")).distinct()
    return lines.select("work_id", "idx", F.trim("line").alias("text")).where("text <> ''").join(asked, "text")


def refusal(words: int, terms: list[str], known: set[str], most_words: int = 7_548_165) -> str | None:
    """Why a vector search can't be made: nothing to search, no term, an unknown term, more words than a model may be made of."""
    if words == 0:
        return "the scope is empty"
    if not [t for t in terms if t]:
        return "no term"
    if words > most_words:
        return f"{words} words, more than {most_words}"
    missing = [t for t in terms if t not in known and t[:1].lower() + t[1:] not in known]
    return f"unknown: {', '.join(missing)}" if missing else None


def neighbours_of_terms(vectors: DataFrame, terms: list[str], k: int = 25, least: float = 0.15) -> DataFrame:
    """vectors: word, embedding. Of one term the k likest words, of two their similarity: a, b, similarity. A term that is unknown is
    tried with a small initial."""
    tried = list(dict.fromkeys([*terms, *(t[:1].lower() + t[1:] for t in terms)]))
    found = {r.word: list(r.embedding) for r in vectors.where(F.col("word").isin(*tried)).collect()}
    names = [t if t in found else t[:1].lower() + t[1:] for t in terms]
    if any(n not in found for n in names):
        return vectors.select(F.lit("").alias("a"), F.col("word").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    if len(names) == 1:
        rows = nearest(vectors.withColumnRenamed("word", "vec_id"), found[names[0]], k, least, without=names)
        return rows.select(F.lit(names[0]).alias("a"), F.col("vec_id").alias("b"), "similarity")
    rows = vectors.where(F.col("word") == names[1])
    return rows.select(F.lit(names[0]).alias("a"), F.col("word").alias("b"), F.round(cosine(F.col("embedding"), F.array(*map(F.lit, found[names[0]]))), 4).alias("similarity"))


def topics(sentences: DataFrame, k: int = 7, features: int = 2000, most_share: float = 0.35, least_docs: int = 5, steps: int = 12, seed: int = 1, terms: int = 8) -> DataFrame:
    """topic, place, word, weight of an online LDA over counts of words neither too common nor too rare."""
    counter = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=features, maxDF=most_share, minDF=least_docs).fit(sentences)
    model = LDA(k=k, maxIter=steps, optimizer="online", learningOffset=50.0, seed=seed, featuresCol="counts").fit(counter.transform(sentences))
    names = F.array(*map(F.lit, counter.vocabulary))
    rows = model.describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    return rows.select("topic", (F.col("place") + 1).alias("place"), F.get(names, F.col("t.termIndices")).alias("word"), F.col("t.termWeights").alias("weight"))


def latent_space(docs: DataFrame, k: int = 20) -> DataFrame:
    """docs: id, words. id and `embedding` of every document with a telling word: its place along the k largest axes of the tf-idf matrix of all words, of
    unit length."""
    _, _, rows = truncated(tfidf(docs, "id", F.col("words")), k)
    length = norm(F.col("row"))
    return rows.select("id", F.transform("row", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0))).alias("embedding"))


def lsi(docs: DataFrame, query: list[str], k: int = 250) -> DataFrame:
    """docs: id, words. id and similarity of each document to a query of words, by cosine along the axes of the k largest singular values of the
    tf-idf matrix, of all words. Only the axes of the query's words come to the driver. Documents without a telling word, and queries without a
    known one, are like nothing."""
    _, axes, rows = truncated(tfidf(docs, "id", F.col("words")), k)
    n = docs.count()
    seen = docs.select(F.explode(F.array_distinct("words")).alias("word")).where(F.col("word").isin(query)).groupBy("word").agg(F.count("*").alias("df"))
    idf = {r.word: float(np.log(n / r.df)) for r in seen.collect()}
    place = {r.word: np.array(r.row) for r in axes.where(F.col("word").isin(query)).collect()}
    q = sum((query.count(w) * idf[w] * place[w] for w in sorted(place)), np.zeros(1))
    asked = F.array(*(F.lit(float(x)) for x in q))
    same = F.coalesce(F.try_divide(dot(F.col("row"), asked), norm(F.col("row")) * norm(asked)), F.lit(0.0)) if place else F.lit(0.0)
    return docs.select("id").join(rows.select("id", same.alias("likeness")), "id", "left").select("id", F.coalesce("likeness", F.lit(0.0)).alias("similarity"))

"""Searches over works (corpus, author, work_id, lines array<string>). All stay inside a work's row,
so they need no shuffle; each ends in lines: corpus, author, work_id, idx, line.

What a line is tested for is a pattern (a Java regular expression; an invalid one finds nothing, as the reader of a search form
expects) or any function from a line to a condition, such as `holding` the forms of a headword."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import corpus
from ..sources.postings import WordIndex


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Java takes the pattern."""
    try:
        spark.range(1).where(F.lit("x").rlike(pattern)).count()
    except PySparkException:
        return False
    return True


def holding(words: list[str], form=F.lower):
    """A test for lines: whether one of their words is among some (the forms of one headword: their number is bounded by its inflection)."""
    pattern = T.index_pattern(words)
    if pattern is not None and words:
        return lambda line: form(line).rlike(pattern)
    return lambda line: F.exists(T.index_tokens(form(line)), lambda w: w.isin(words)) if words else F.lit(False)


def _test(what, form):
    return what if callable(what) else lambda line: form(line).rlike(what)


def _numbered(lines: Column) -> Column:
    """(idx, line) of each line of a work."""
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("idx"), line.alias("line")))


def _found(works: DataFrame, hits: Column) -> DataFrame:
    keys = [c for c in works.columns if c != "lines"]
    return works.select(*keys, F.explode(hits).alias("hit")).select(*keys, "hit.idx", "hit.line")


def simple(works: DataFrame, pattern, form=F.lower) -> DataFrame:
    """Lines that pass the test: lines become rows first, so that generation and filter are compiled as one."""
    return corpus.lines(works).where(_test(pattern, form)(F.col("line"))).select(*(c for c in works.columns if c != "lines"), "idx", "line")


def near_lines(works: DataFrame, pattern, other, distance: int, near: bool = True, form=F.lower) -> DataFrame:
    """Lines that pass the test, with (or without) a line that passes the other in the same work at most `distance` lines away."""
    first, other = _test(pattern, form), _test(other, form)
    second = F.filter(_numbered(F.col("lines")), lambda x: other(x["line"]))
    rows = works.withColumn("second", F.transform(second, lambda x: x["idx"]))
    close = lambda x: F.exists("second", lambda k: F.abs(k - x["idx"]) <= distance)
    wanted = (lambda x: close(x)) if near else (lambda x: ~close(x))
    return _found(rows, F.filter(_numbered(F.col("lines")), lambda x: first(x["line"]) & wanted(x))).drop("second")


def _phrase_hits(words: str, form) -> Column:
    """(idx, line, next) of the lines that hold the whole phrase, or whose end and the next line's beginning do."""
    parts = [w for w in words.split(" ") if w]
    alone = rf"(^|\s){' '.join(parts)}(\s|$)"
    splits = [(rf"(^|\s){' '.join(parts[:k])}\s*$", rf"^\s*{' '.join(parts[k:])}(\s|$)") for k in range(1, len(parts))]
    nexts = F.transform("lines", lambda line, i: F.struct((i + 1).alias("idx"), line.alias("line"), F.coalesce(F.get("lines", i + 1), F.lit("")).alias("next")))

    def fits(x):
        found = form(x["line"]).rlike(alone)
        for head, tail in splits:
            found = found | (form(x["line"]).rlike(head) & form(x["next"]).rlike(tail))
        return found

    return F.filter(nexts, fits)


def phrase(works: DataFrame, words: str, form=F.lower) -> DataFrame:
    """Lines that hold the whole phrase, or whose end and the next line's beginning do. The next line is one of the same work."""
    return _found(works, _phrase_hits(words, form))


def phrase_window(works: DataFrame, pattern: str, form=F.lower) -> DataFrame:
    """Lines where the pattern is found in the line joined with the next one."""
    nexts = F.transform("lines", lambda line, i: F.struct((i + 1).alias("idx"), line.alias("line"), F.concat(line, F.lit(" "), F.coalesce(F.get("lines", i + 1), F.lit(""))).alias("both")))
    return _found(works, F.filter(nexts, lambda x: form(x["both"]).rlike(pattern)))


def phrase_near(works: DataFrame, words: str, other, distance: int, near: bool = True, form=F.lower) -> DataFrame:
    """Phrase hits with (or without) a match of the other pattern at most `distance` lines away in the same work: told inside the work's row."""
    test = _test(other, form)
    second = F.transform(F.filter(_numbered(F.col("lines")), lambda x: test(x["line"])), lambda x: x["idx"])
    close = lambda x: F.exists("second", lambda k: F.abs(k - x["idx"]) <= distance)
    hits = F.filter(_phrase_hits(words, form), (lambda x: close(x)) if near else (lambda x: ~close(x)))
    return _found(works.withColumn("second", second), hits).drop("second")


def work_tokens(works: DataFrame, form=F.lower) -> DataFrame:
    """works with `words`: (word, idx) of all its lines in order."""
    words = F.flatten(F.transform("lines", lambda line, i: F.transform(T.tokens(form(line)), lambda w: F.struct(w.alias("word"), (i + 1).alias("idx")))))
    return works.withColumn("words", words)


def _word(what):
    """A test for one word: equality with a text, or any function to a condition."""
    return what if callable(what) else lambda w: w == what


def one_of(words: list[str]):
    """A test for words: whether they are among some; the index forms of both sides meet."""
    return lambda w: T.index_form(w).isin(words) if words else F.lit(False)


def _first_places(rows: DataFrame, hit, length: int = 1) -> DataFrame:
    """rows with `firsts`: (idx, at) of the first hit of each line. hit: places i of `words` at which something of `length` words begins."""
    places = F.filter(F.transform("words", lambda w, i: F.struct(w["idx"].alias("idx"), i.alias("at"), hit(i).alias("fits"))), lambda w: w["fits"])
    rows = rows.withColumn("firsts", places)
    # sorted by place: an entry whose line differs from that before it
    return rows.withColumn("firsts", F.filter("firsts", lambda w, i: (i == 0) | (F.get("firsts", i - 1)["idx"] != w["idx"])))


def _before(at: Column, distance: int) -> Column:
    return F.slice("words", F.greatest(at - distance + 1, F.lit(1)), F.when(at < distance, at).otherwise(distance))


def near_words(works: DataFrame, word, other, distance: int, near: bool = True, form=F.lower) -> DataFrame:
    """Lines with a word (or phrase, a list of words) whose first occurrence has (or lacks) the other word among `distance` words on
    either side of it, over line borders and inside the work."""
    parts = [_word(w) for w in (word if isinstance(word, list) else [word])]
    other = _word(other)

    def hit(i):
        found = parts[0](F.get("words", i)["word"])
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(part(F.get("words", i + k)["word"]), F.lit(False))
        return found

    rows = _first_places(work_tokens(works, form), hit, len(parts))
    after = lambda w: F.slice("words", w["at"] + 1 + len(parts), F.lit(distance))
    close = lambda w: F.exists(_before(w["at"], distance), lambda v: other(v["word"])) | F.exists(after(w), lambda v: other(v["word"]))
    hits = F.filter("firsts", (lambda w: close(w)) if near else (lambda w: ~close(w)))
    keys = [c for c in works.columns if c != "lines"]
    hit_ = F.transform(hits, lambda w: F.struct(w["idx"].alias("idx"), F.get("lines", w["idx"] - 1).alias("line")))
    return rows.select(*keys, F.explode(hit_).alias("hit")).select(*keys, "hit.idx", "hit.line")


def neighbours_of_word(works: DataFrame, word, distance: int, form=F.lower) -> DataFrame:
    """For each first hit of a line the words before and after it, at most `distance` each."""
    test = _word(word)
    rows = _first_places(work_tokens(works, form), lambda i: test(F.get("words", i)["word"]))
    text = lambda part: F.array_join(F.transform(part, lambda v: v["word"]), " ")
    out = F.transform("firsts", lambda w: F.struct(w["idx"].alias("idx"), text(_before(w["at"], distance)).alias("leading"), text(F.slice("words", w["at"] + 2, F.lit(distance))).alias("lagging")))
    keys = [c for c in works.columns if c != "lines"]
    return rows.select(*keys, F.explode(out).alias("hit")).select(*keys, "hit.idx", "hit.leading", "hit.lagging")


def window_matches(works: DataFrame, word, pattern: str, distance: int, near: bool = True, form=F.lower) -> DataFrame:
    """First hits of a word whose `distance` words before, or those after, match (or neither do) a pattern as one text."""
    fits = F.col("leading").rlike(pattern) | F.col("lagging").rlike(pattern)
    return neighbours_of_word(works, word, distance, form).where(fits if near else ~fits)


def lemma(works: DataFrame, words: list[str], form=F.lower) -> DataFrame:
    """Lines that hold a form of a headword, given its forms (see forms_of): no join and no shuffle of lines."""
    return simple(works, holding(words, form))


def forms_of(forms: DataFrame, headword: str) -> list[str]:
    """The forms of one headword: as many as it has inflections, so they fit a test."""
    return sorted(r.form for r in forms.where(F.col("headword") == headword).select("form").distinct().collect())


def term_or_headword(works: DataFrame, term: str, forms: DataFrame) -> DataFrame:
    """What a click on a word looks for: the lines of all forms of the headword if it is one, else those of the word itself."""
    found = forms_of(forms, term)
    return lemma(works, found) if found else simple(works, T.term_pattern(f" {term} "))


def extended_lines(works: DataFrame, words: int) -> DataFrame:
    """Every line with the last words of the one before and the first of the next."""
    last = lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - words + 1, F.lit(1)), F.lit(words)), " ")
    first = lambda x: F.array_join(F.slice(x, 1, words), " ")
    of = lambda k: T.tokens(F.coalesce(F.get("lines", k), F.lit("")))
    rows = F.transform("lines", lambda line, i: F.struct((i + 1).alias("idx"), F.trim(F.concat_ws(" ", last(of(i - 1)), line, first(of(i + 1)))).alias("line")))
    return _found(works, rows)


def one_per_author(hits: DataFrame) -> DataFrame:
    """The first hit of each author, by aggregation: no author's hits are sorted in one task."""
    first = F.min(F.struct("work_id", "idx", "line"))
    return hits.groupBy("corpus", "author").agg(first.alias("hit")).select("corpus", "author", "hit.work_id", "hit.idx", "hit.line")


def first_per_author(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each author. Ranks are limited before the shuffle as well, so an author sends at most k rows a task."""
    order = Window.partitionBy("author").orderBy("work_id", "idx")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def capped(hits: DataFrame, cap: int, order: list) -> DataFrame:
    """The first `cap` hits of a sort, numbered from 1. Only the cap's rows meet in one task."""
    top = hits.orderBy(*order).limit(cap)
    return top.withColumn("number", F.row_number().over(Window.orderBy(*order)))


def with_context(hits: DataFrame, works: DataFrame, context: int) -> DataFrame:
    """For each hit its lines idx - floor(context / 2) .. idx + ceil-less half, those of its work only: hit_idx, idx, line. A work meets
    its hits in one row, and what leaves that row are the lines of the windows, not the work once for each of them."""
    low = lambda h: F.greatest(F.floor(h - F.lit(context) / 2).cast("int"), F.lit(1))
    high = lambda h: F.least(F.floor(h + F.lit(context) / 2).cast("int"), F.size("lines"))
    wanted = hits.groupBy("work_id").agg(F.collect_set("idx").alias("hits_"))
    window = lambda h: F.transform(F.sequence(low(h), high(h)), lambda i: F.struct(h.alias("hit_idx"), i.alias("idx"), F.get("lines", i - 1).alias("line")))
    rows = works.select("work_id", "lines").join(wanted, "work_id").select("work_id", F.explode(F.flatten(F.transform("hits_", window))).alias("x"))
    return rows.select("work_id", "x.hit_idx", "x.idx", "x.line")


def rarest_term(index: WordIndex, terms: list[str]) -> DataFrame:
    """The terms by how often they occur as words (0 where never), rarest first: from the stored index, whose rows of these words alone are read."""
    spark = index.spark
    wanted = spark.createDataFrame([(t, t.lower()) for t in terms], "term string, raw string")
    keys = [r.word for r in wanted.select(T.index_form(F.col("term")).alias("word")).distinct().collect()]
    counted = index.counts(keys, by="raw").select("raw", "n")
    return wanted.join(counted, "raw", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "term")


def sort_hits(hits: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Hits with their catalog row, sorted by name, date (undated last), genre, location or work."""
    rows = hits.join(catalog.select("work_id", "title", "date", "author_date", "genre", "location"), "work_id", "left")
    date = F.coalesce(F.when(F.col("date") > 2000, F.col("author_date")).otherwise(F.col("date")), F.lit(9999))
    by = {"name": F.col("author"), "date": date, "genre": F.col("genre"), "location": F.col("location"), "work": F.col("work_id")}[key]
    return rows.orderBy(by, "author", "work_id", "idx")

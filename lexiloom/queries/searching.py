"""Search queries: simple, proximity by lines and words, phrases, lemmata, caps, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concordance as C
from ..operators import search as S
from ..registry import query
from ..sources import corpus
from ..sources.postings import WordIndex
from .sql import CATALOG, LINES, TOKENS, fold

WORD = T.term_pattern(" the ")
OTHER = T.term_pattern(" of ")
KEYS = ("corpus", "author", "work_id", "idx")
HIT = rf"regexp_matches(lower(line), '{WORD}')"
SECOND = rf"regexp_matches(lower(line), '{OTHER}')"


@query(f"WITH {LINES} SELECT corpus, author, work_id, idx, line FROM lines WHERE {HIT}")
def simple_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.simple(corpus.works(spark, sf), WORD)


@query(rf"WITH {LINES} SELECT work_id, idx, line FROM lines WHERE regexp_matches(lower(line), '(^|\s)th[a-z]*ing(\s|$)')")
def regex_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.simple(corpus.works(spark, sf), T.anchored(" th[a-z]*ing ")).select("work_id", "idx", "line")


@query(f"WITH {LINES}, hits AS (SELECT * FROM lines WHERE corpus = 'en' AND {HIT}), ranked AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY work_id, idx) AS place FROM hits), top AS (SELECT *, (row_number() OVER (ORDER BY author, work_id, idx))::INT AS number FROM ranked WHERE place <= 5 ORDER BY author, work_id, idx LIMIT 100) SELECT t.number, t.author, t.work_id, t.idx AS hit_idx, l.idx, l.line FROM top t JOIN lines l ON l.work_id = t.work_id AND l.idx BETWEEN t.idx - 2 AND t.idx + 2")
def simple_search_topk_author(spark: SparkSession, sf: str) -> DataFrame:
    works = corpus.works(spark, sf).where(F.col("corpus") == "en")
    order = ["author", "work_id", "idx"]
    top = S.capped(S.first_per_author(S.simple(works, WORD), 5), 100, order)
    around = S.with_context(top, works, 4)
    return top.select("number", "author", "work_id", F.col("idx").alias("hit_idx")).join(around, ["work_id", "hit_idx"]).select("number", "author", "work_id", "hit_idx", "idx", "line")


@query(f"WITH {LINES}, hits AS (SELECT *, row_number() OVER (PARTITION BY corpus, author ORDER BY work_id, idx) AS k FROM lines WHERE {HIT}) SELECT corpus, author, work_id, idx, line FROM hits WHERE k = 1")
def one_hit_per_author(spark: SparkSession, sf: str) -> DataFrame:
    return S.one_per_author(S.simple(corpus.works(spark, sf), WORD))


@query(f"WITH {LINES}, hits AS (SELECT * FROM lines WHERE regexp_matches(lower(line), '(^|\\s)whst(\\s|$)')) SELECT h.work_id, h.idx AS hit_idx, l.idx, l.line FROM hits h JOIN lines l ON l.work_id = h.work_id AND l.idx BETWEEN floor(h.idx - 1.5) AND floor(h.idx + 1.5)")
def search_with_context(spark: SparkSession, sf: str) -> DataFrame:
    works = corpus.works(spark, sf)
    return S.with_context(S.simple(works, T.term_pattern(" whst ")), works, 3)


_NEAR = f"WITH {LINES}, marked AS (SELECT *, max(CASE WHEN {SECOND} THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines) SELECT work_id, idx, line FROM marked WHERE {HIT} AND near = "


@query(_NEAR + "1")
def near_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_lines(corpus.works(spark, sf), WORD, OTHER, 2).select("work_id", "idx", "line")


@query(_NEAR + "0")
def not_near_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_lines(corpus.works(spark, sf), WORD, OTHER, 2, near=False).select("work_id", "idx", "line")


_WORDS = f"""WITH {LINES}, parts AS (SELECT work_id, idx, list_filter(string_split(replace(lower(line), chr(160), ' '), ' '), lambda w: w <> '') AS ws FROM lines),
stream AS (SELECT work_id, idx, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY idx, k) AS spot FROM stream),
firsts AS (SELECT work_id, idx, min(spot) AS spot FROM placed WHERE word = 'the' GROUP BY work_id, idx),
near AS (SELECT DISTINCT f.work_id, f.idx FROM firsts f JOIN placed p ON p.work_id = f.work_id AND p.word = 'and' AND p.spot BETWEEN f.spot - 4 AND f.spot + 4 AND p.spot <> f.spot)
"""


@query(_WORDS + "SELECT work_id, idx FROM near")
def near_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_words(corpus.works(spark, sf), "the", "and", 4).select("work_id", "idx")


@query(_WORDS + "SELECT work_id, idx FROM firsts EXCEPT SELECT work_id, idx FROM near")
def not_near_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_words(corpus.works(spark, sf), "the", "and", 4, near=False).select("work_id", "idx")


@query(_WORDS + "SELECT f.work_id, f.idx, coalesce(string_agg(CASE WHEN p.spot < f.spot THEN p.word END, ' ' ORDER BY p.spot), '') AS leading, coalesce(string_agg(CASE WHEN p.spot > f.spot THEN p.word END, ' ' ORDER BY p.spot), '') AS lagging FROM firsts f JOIN placed p ON p.work_id = f.work_id AND p.spot BETWEEN f.spot - 3 AND f.spot + 3 GROUP BY f.work_id, f.idx")
def leading_and_lagging_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.neighbours_of_word(corpus.works(spark, sf), "the", 3).select("work_id", "idx", "leading", "lagging")


_NEXT = f"WITH {LINES}, pairs AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY work_id ORDER BY idx), '') AS next FROM lines)"
_PHRASE = r"(regexp_matches(lower(line), '(^|\s)of the(\s|$)') OR (regexp_matches(lower(line), '(^|\s)of\s*$') AND regexp_matches(lower(next), '^\s*the(\s|$)')))"


@query(f"{_NEXT} SELECT work_id, idx, line FROM pairs WHERE {_PHRASE}")
def phrase_cross_line(spark: SparkSession, sf: str) -> DataFrame:
    return S.phrase(corpus.works(spark, sf), "of the").select("work_id", "idx", "line")


@query("WITH pairs AS (SELECT conv_id, turn, text AS line, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS next FROM conversations) SELECT conv_id, turn FROM pairs WHERE regexp_matches(lower(line) || ' ' || lower(next), 'the\\s+\\w')")
def phrase_window_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = corpus.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(x["turn"].alias("turn"), F.concat(F.lower(x["text"]), F.lit(" "), F.lower(F.coalesce(F.get("t", i + 1)["text"], F.lit("")))).alias("both")))
    return turns.select("conv_id", F.explode(F.filter(pairs, lambda x: x["both"].rlike(r"the\s+\w"))).alias("x")).select("conv_id", "x.turn")


@query(rf"{_NEXT} SELECT work_id, idx, line FROM pairs WHERE regexp_matches(lower(line || ' ' || next), '(^|\s)and[,.]? the(\s|$)')")
def phrase_window(spark: SparkSession, sf: str) -> DataFrame:
    return S.phrase_window(corpus.works(spark, sf), T.anchored(" and[,.]? the ")).select("work_id", "idx", "line")


_PNEAR = f"{_NEXT}, marked AS (SELECT *, max(CASE WHEN regexp_matches(lower(line), '(^|\\s)with(\\s|$)') THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM pairs) SELECT work_id, idx, line FROM marked WHERE {_PHRASE} AND near = "


@query(_PNEAR + "1")
def phrase_near_word(spark: SparkSession, sf: str) -> DataFrame:
    return S.phrase_near(corpus.works(spark, sf), "of the", T.term_pattern(" with "), 1).select("work_id", "idx", "line")


@query(_PNEAR + "0")
def phrase_not_near_word(spark: SparkSession, sf: str) -> DataFrame:
    return S.phrase_near(corpus.works(spark, sf), "of the", T.term_pattern(" with "), 1, near=False).select("work_id", "idx", "line")


#: forms and their headwords by the suffix rule, from the vocabulary itself
FORMS = """vocabulary AS (SELECT DISTINCT word FROM tokens), forms AS (
  SELECT DISTINCT word AS form, unnest(list_filter([word, CASE WHEN word LIKE '%s' AND len(word) >= 4 THEN word[:-2] END, CASE WHEN word LIKE '%es' AND len(word) >= 5 THEN word[:-3] END,
    CASE WHEN word LIKE '%ed' AND len(word) >= 5 THEN word[:-3] END, CASE WHEN word LIKE '%ing' AND len(word) >= 6 THEN word[:-4] END], lambda x: x IS NOT NULL)) AS headword FROM vocabulary
)"""


def word_index(spark: SparkSession, sf: str) -> WordIndex:
    """The stored index of the corpus, brought up to date."""
    index = WordIndex(spark, sf)
    index.refresh()
    return index


def forms_of(spark: SparkSession, sf: str, headword: str) -> DataFrame:
    """form, headword of one headword: what the index has of its possible forms."""
    found = word_index(spark, sf).known(C.possible_forms(headword))
    return spark.createDataFrame([(w, headword) for w in found], "form string, headword string")


def _holding(spark: SparkSession, sf: str, *headwords: str):
    """The works that hold a form of every one of some headwords, and a test for the forms of each."""
    index = word_index(spark, sf)
    forms = [index.known(C.possible_forms(h)) for h in headwords]
    return corpus.as_works(index.docs_holding(*forms)), [S.holding(f) for f in forms]


def all_forms(spark: SparkSession, sf: str) -> DataFrame:
    return C.suffix_forms(C.words(corpus.lines(corpus.works(spark, sf))).select("word").distinct())


@query(f"WITH {TOKENS}, {FORMS} SELECT DISTINCT t.corpus, t.author, t.work_id, t.idx FROM tokens t JOIN forms f ON t.word = f.form WHERE f.headword = 'the'")
def lemma_search(spark: SparkSession, sf: str) -> DataFrame:
    works, (the,) = _holding(spark, sf, "the")
    return S.simple(works, the).select(*KEYS)


_LEMMATA = f"WITH {TOKENS}, {FORMS}, h AS (SELECT DISTINCT work_id, idx FROM tokens JOIN forms ON word = form WHERE headword = 'the'), o AS (SELECT DISTINCT work_id, idx FROM tokens JOIN forms ON word = form WHERE headword = 'of')"


@query(_LEMMATA + " SELECT work_id, idx FROM h WHERE EXISTS (SELECT 1 FROM o WHERE o.work_id = h.work_id AND abs(o.idx - h.idx) <= 1)")
def lemma_near_lemma(spark: SparkSession, sf: str) -> DataFrame:
    works, (the, of) = _holding(spark, sf, "the", "of")
    return S.near_lines(works, the, of, 1).select("work_id", "idx")


@query(f"WITH {TOKENS}, {FORMS} SELECT 'headword' AS kind, work_id, idx FROM tokens JOIN forms ON word = form WHERE headword = 'whst' GROUP BY ALL UNION ALL SELECT 'word', work_id, idx FROM lines WHERE regexp_matches(lower(line), '(^|\\s)the,(\\s|$)')")
def word_or_headword(spark: SparkSession, sf: str) -> DataFrame:
    works, found = corpus.works(spark, sf), None
    for kind, term in (("headword", "whst"), ("word", "the,")):
        rows = S.term_or_headword(works, term, forms_of(spark, sf, term)).select(F.lit(kind).alias("kind"), "work_id", "idx")
        found = rows if found is None else found.unionByName(rows)
    return found


@query(_WORDS.rstrip() + ", around AS (SELECT f.work_id, f.idx, coalesce(string_agg(CASE WHEN p.spot < f.spot THEN p.word END, ' ' ORDER BY p.spot), '') AS leading, coalesce(string_agg(CASE WHEN p.spot > f.spot THEN p.word END, ' ' ORDER BY p.spot), '') AS lagging FROM firsts f JOIN placed p ON p.work_id = f.work_id AND p.spot BETWEEN f.spot - 3 AND f.spot + 3 GROUP BY f.work_id, f.idx) SELECT * FROM around AS a_ WHERE regexp_matches(a_.leading, 'of t[a-z]*|and$') OR regexp_matches(a_.lagging, 'of t[a-z]*|and$')")
def word_window_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return S.window_matches(corpus.works(spark, sf), "the", "of t[a-z]*|and$", 3).select("work_id", "idx", "leading", "lagging")


_PWORDS = _WORDS.split("firsts AS")[0] + """begins AS (SELECT a.work_id, a.idx, min(a.spot) AS spot FROM placed a JOIN placed b ON b.work_id = a.work_id AND b.spot = a.spot + 1 AND a.word = 'of' AND b.word = 'the' GROUP BY a.work_id, a.idx),
close AS (SELECT DISTINCT f.work_id, f.idx FROM begins f JOIN placed p ON p.work_id = f.work_id AND p.word = 'and' AND (p.spot BETWEEN f.spot - 5 AND f.spot - 1 OR p.spot BETWEEN f.spot + 2 AND f.spot + 6))"""


@query(_PWORDS + " SELECT * FROM close")
def phrase_near_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_words(corpus.works(spark, sf), ["of", "the"], "and", 5).select("work_id", "idx")


@query(_PWORDS + " SELECT work_id, idx FROM begins EXCEPT SELECT * FROM close")
def phrase_not_near_words(spark: SparkSession, sf: str) -> DataFrame:
    return S.near_words(corpus.works(spark, sf), ["of", "the"], "and", 5, near=False).select("work_id", "idx")


@query(rf"WITH {LINES} SELECT 'é' AS term, work_id, idx FROM lines WHERE regexp_matches(lower(line), '(^|\s)é(\s|$)') UNION ALL SELECT 'e', work_id, idx FROM lines WHERE regexp_matches({fold('line')}, '(^|\s)e(\s|$)')")
def accented_or_plain(spark: SparkSession, sf: str) -> DataFrame:
    """A term with accents is looked for in lines as they are, one without in folded lines."""
    works, found = corpus.works(spark, sf), None
    for term in (" é ", " e "):
        rows = S.simple(works, T.term_pattern(term), T.line_form(term)).select(F.lit(term.strip()).alias("term"), "work_id", "idx")
        found = rows if found is None else found.unionByName(rows)
    return found


_ANY = T.any_accent_pattern("ere")


@query(f"WITH {LINES} SELECT work_id, idx FROM lines WHERE regexp_matches(line, '{_ANY}')")
def any_accents(spark: SparkSession, sf: str) -> DataFrame:
    return S.simple(corpus.works(spark, sf), _ANY, form=lambda line: line).select("work_id", "idx")


@query(f"WITH {LINES}, words AS (SELECT unnest(list_filter(string_split(replace(lower(line), chr(160), ' '), ' '), lambda w: w <> '')) AS w FROM lines) SELECT term, count(w)::BIGINT AS n FROM (VALUES ('the'), ('with'), ('whst'), ('zzz')) v(term) LEFT JOIN words ON w = term GROUP BY term")
def least_common_term(spark: SparkSession, sf: str) -> DataFrame:
    return S.rarest_term(word_index(spark, sf), ["the", "with", "whst", "zzz"])


@query(f"WITH {TOKENS} SELECT word, count(*)::BIGINT AS n, count(DISTINCT work_id)::BIGINT AS works FROM tokens GROUP BY word")
def indexed_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the stored index, how often it occurs and in how many works."""
    return word_index(spark, sf).counts().where("word <> ''")


@query(f"WITH {TOKENS}, {FORMS}, k AS (SELECT DISTINCT work_id FROM tokens JOIN forms ON word = form WHERE headword = 'whst'), o AS (SELECT DISTINCT work_id FROM tokens JOIN forms ON word = form WHERE headword = 'of') SELECT work_id FROM k JOIN o USING (work_id)")
def works_holding_headwords(spark: SparkSession, sf: str) -> DataFrame:
    """Works that hold a form of each of two headwords, told by the index alone: no text is read."""
    index = word_index(spark, sf)
    one, other = (index.holding(index.known(C.possible_forms(h))) for h in ("whst", "of"))
    return one.join(other, "work_id", "left_semi")


@query(f"WITH {LINES}, parts AS (SELECT work_id, idx, line, list_filter(string_split(replace(line, chr(160), ' '), ' '), lambda w: w <> '') AS ws FROM lines), ext AS (SELECT work_id, idx, line, lag(ws) OVER w AS p, lead(ws) OVER w AS n FROM parts WINDOW w AS (PARTITION BY work_id ORDER BY idx)) SELECT work_id, idx, trim(concat_ws(' ', coalesce(array_to_string(p[-2:], ' '), ''), line, coalesce(array_to_string(n[:2], ' '), '')), ' ') AS line FROM ext")
def extended_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.extended_lines(corpus.works(spark, sf), 2).select("work_id", "idx", "line")


@query(f"WITH {LINES}, {CATALOG}, hits AS (SELECT l.work_id, l.idx, l.author, CASE WHEN d.date > 2000 THEN d.author_date ELSE d.date END AS raw FROM lines l JOIN dated d USING (work_id) WHERE regexp_matches(lower(l.line), '(^|\\s)whst(\\s|$)')) SELECT work_id, idx, author, coalesce(raw, 9999) AS year, (row_number() OVER (ORDER BY coalesce(raw, 9999), author, work_id, idx))::INT AS number FROM hits ORDER BY number LIMIT 200")
def hits_sorted_by_date(spark: SparkSession, sf: str) -> DataFrame:
    catalog = corpus.works_catalog(spark, sf)
    rows = S.simple(corpus.works(spark, sf), T.term_pattern(" whst ")).join(catalog.join(corpus.authors(catalog), "author", "left").select("work_id", "date", "author_date"), "work_id")
    year = F.coalesce(F.when(F.col("date") > 2000, F.col("author_date")).otherwise(F.col("date")), F.lit(9999))
    rows = rows.select("work_id", "idx", "author", year.alias("year"))
    return S.capped(rows, 200, ["year", "author", "work_id", "idx"])


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<title>[^<]*the[^<]*</title>')")
def search_inside_markup(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "pages").where(F.col("html").rlike("<title>[^<]*the[^<]*</title>")).select("page_id")


def _planned(spark: SparkSession, sf: str, forms: DataFrame | None = None, **what) -> DataFrame:
    from ..plans.spec import SearchSpec, plan

    return plan(SearchSpec(**what), corpus.works(spark, sf), corpus.works_catalog(spark, sf), forms)


FOLDED_HIT = f"regexp_matches({fold('line')}, '{WORD}')"
_FOLDED_PHRASE = _PHRASE.replace("lower(line)", fold("line")).replace("lower(next)", fold("next"))


@query(f"WITH {LINES}, {CATALOG}, h AS (SELECT l.author, l.work_id, d.title, l.idx, l.line FROM lines l JOIN dated d USING (work_id) WHERE d.corpus IN ('en', 'fr') AND d.genre LIKE '%epic%' AND {FOLDED_HIT}) SELECT (row_number() OVER (ORDER BY author, work_id, idx))::INT AS number, * FROM h ORDER BY author, work_id, idx LIMIT 200")
def planned_simple(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scope import Scope

    return _planned(spark, sf, term=" the ", scope=Scope(corpora=("en", "fr"), genres=("epic",)))


@query(f"{_NEXT.replace('WITH ' + LINES, 'WITH ' + LINES + ', ' + CATALOG)}, h AS (SELECT p.author, p.work_id, d.title, d.genre, p.idx, p.line FROM pairs p JOIN dated d USING (work_id) WHERE d.corpus = 'en' AND {_FOLDED_PHRASE}) SELECT (row_number() OVER (ORDER BY genre, author, work_id, idx))::INT AS number, author, work_id, title, idx, line FROM h ORDER BY genre, author, work_id, idx LIMIT 100")
def planned_phrase_by_genre(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scope import Scope

    return _planned(spark, sf, term="of the", scope=Scope(corpora=("en",)), cap=100, sort="genre")


_BOTH = f"{_LEMMATA}, {CATALOG}, p AS (SELECT h.work_id, h.idx FROM h WHERE EXISTS (SELECT 1 FROM o WHERE o.work_id = h.work_id AND abs(o.idx - h.idx) <= 1)), j AS (SELECT l.author, l.work_id, d.title, l.idx, l.line FROM p JOIN lines l USING (work_id, idx) JOIN dated d USING (work_id) WHERE d.corpus = 'en') SELECT (row_number() OVER (ORDER BY author, work_id, idx))::INT AS number, * FROM j ORDER BY author, work_id, idx LIMIT 200"


@query(_BOTH)
def planned_lemma_proximity(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scope import Scope

    forms = forms_of(spark, sf, "the").unionByName(forms_of(spark, sf, "of"))
    return _planned(spark, sf, forms, lemma="the", other_lemma="of", distance=1, scope=Scope(corpora=("en",)))


@query(f"{_PWORDS}, {CATALOG}, j AS (SELECT l.author, l.work_id, d.title, l.idx, l.line FROM close c JOIN lines l USING (work_id, idx) JOIN dated d USING (work_id) WHERE d.corpus = 'en') SELECT (row_number() OVER (ORDER BY author, work_id, idx))::INT AS number, * FROM j ORDER BY author, work_id, idx LIMIT 200")
def planned_phrase_near_words(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scope import Scope

    return _planned(spark, sf, term="of the", other="and", unit="words", distance=5, scope=Scope(corpora=("en",)))

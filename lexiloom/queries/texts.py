"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import walks as W
from ..operators import browse as B
from ..operators import scope as P
from ..operators import search as S
from ..operators import vectors as V
from ..plans.selection import are_only
from ..plans.spec import mask_of
from ..registry import query
from ..sources import corpus
from .sql import BARE, LINES, TOKENS, bare, fold, quoted


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.lines(corpus.works(spark, sf))


_SPLIT = "list_filter(string_split(replace(line, chr(160), ' '), ' '), lambda w: w <> '')"


@query(f"WITH {LINES} SELECT corpus, author, work_id, idx, line FROM lines")
def lines_base(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)


@query(f"WITH {LINES} SELECT work_id, idx, len({_SPLIT})::INT AS words, len(list_distinct({_SPLIT}))::INT AS distinct_words, coalesce({_SPLIT}[1], '') AS first_word, coalesce({_SPLIT}[-1], '') AS last_word FROM lines")
def line_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = T.tokens(F.col("line"))
    return _lines(spark, sf).select("work_id", "idx", F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct_words"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first_word"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("last_word"))


@query(f"WITH {LINES} SELECT work_id, idx, {fold('line')} AS folded FROM lines")
def folded_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("work_id", "idx", T.fold(F.col("line")).alias("folded"))


@query(f"WITH {TOKENS} SELECT work_id, idx, word, count(*)::BIGINT AS n FROM tokens GROUP BY work_id, idx, word")
def index_tokens_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select("work_id", "idx", F.explode(T.index_tokens(F.col("line"))).alias("word"))
    return rows.groupBy("work_id", "idx", "word").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain, lower(regexp_replace(html, '<[^>]*>', '', 'g')) LIKE '%the%' AS has_the FROM pages")
def strip_markup_pages(spark: SparkSession, sf: str) -> DataFrame:
    plain = T.strip_markup(F.col("html"))
    return corpus.table(spark, sf, "pages").select("page_id", plain.alias("plain"), F.lower(plain).contains("the").alias("has_the"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS links, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) AS lang, (length(html) - length(replace(html, '<span', '')))::INT // 5 AS spans FROM pages")
def markup_attributes(spark: SparkSession, sf: str) -> DataFrame:
    links = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))), " ")
    return corpus.table(spark, sf, "pages").select("page_id", links.alias("links"), B.metadata(F.col("html"), "lang").alias("lang"), F.regexp_count("html", F.lit("<span")).cast("int").alias("spans"))


@query(rf"""WITH {LINES} SELECT work_id, idx,
  translate(regexp_replace(lower(line), '[\p{{P}}\p{{S}}\p{{N}}]', '', 'g'), 'vj', 'ui') AS tidy, regexp_replace(line, '[\p{{P}}\p{{S}}]', '', 'g') AS depunct,
  translate(lower(line), 'vjσς', 'uiϲϲ') AS lemma, regexp_replace(line, '[^\p{{L}}\p{{N}} .,:;_|''-]', '', 'g') AS citation, regexp_matches(line, '[a-z]') AS latin,
  regexp_replace(line, '(\bthe\b)', '<b>\1</b>', 'g') AS shown, regexp_matches(line, '\([^)]*$') AS opens, regexp_matches(line, '^[^(]*\)') AS closes FROM lines""")
def text_functions_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("line")
    return _lines(spark, sf).select("work_id", "idx", T.tidy(c).alias("tidy"), T.depunct(c).alias("depunct"), T.lemma_form(c).alias("lemma"), T.citation_characters(c).alias("citation"), T.is_latin(c).alias("latin"), T.highlight(c, r"\bthe\b").alias("shown"), T.opens_bracket(c, "round").alias("opens"), T.closes_bracket(c, "round").alias("closes"))


@query("SELECT p_partkey, replace(replace(p_name, 'v', 'u'), 'V', 'U') AS u_name, CASE WHEN p_size % 2 = 0 THEN p_size || ' CE' ELSE p_size || ' BCE' END AS year, string_split(p_name, ' ')[1] AS head, array_to_string(string_split(p_name, ' ')[2:], ' ') AS tail FROM part")
def part_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    split = F.get(T.phrase_splits(F.split("p_name", " ")), F.lit(0))
    return corpus.table(spark, sf, "part").select("p_partkey", T.u_for_v_outside_markup(F.col("p_name")).alias("u_name"), T.year_label(F.when(size % 2 == 0, size).otherwise(-size)).alias("year"), split["head"].alias("head"), split["tail"].alias("tail"))


_POINTED = r"[\p{L}\p{N}_]+\."
_WRITTEN_OUT = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in (T.PRAENOMINA | T.DATE_WORDS).items()) + "}"
_WHOLE = f"array_to_string(list_transform(list_zip(string_split_regex(t, '{_POINTED}'), list_append(list_transform(regexp_extract_all(t, '{_POINTED}'), lambda w: coalesce({_WRITTEN_OUT}[w], w)), '')), lambda z: z[1] || z[2]), '')"
SENTENCES = rf"""bare_texts AS (SELECT doc_id AS work_id, replace(regexp_replace(replace(text, chr(10), ' '), '<[^>]*>', '', 'g'), '&nbsp;', '') AS t FROM documents),
whole_texts AS (SELECT work_id, {fold(_WHOLE)} AS t FROM bare_texts),
raw AS (SELECT work_id, unnest(string_split_regex(t, '[.?!·;]')) AS s, generate_subscripts(string_split_regex(t, '[.?!·;]'), 1) AS k FROM whole_texts),
worded AS (SELECT work_id, k, list_filter(string_split(replace(regexp_replace(s, '[\p{{P}}\p{{S}}]', '', 'g'), chr(160), ' '), ' '), lambda w: w <> '') AS words FROM raw),
sentences AS (SELECT work_id, (row_number() OVER (PARTITION BY work_id ORDER BY k))::INT AS sentence, words FROM worded WHERE len(words) > 0)"""


@query(f"WITH {SENTENCES} SELECT work_id, sentence, array_to_string(words, ' ') AS bag FROM sentences")
def sentence_bags_plain(spark: SparkSession, sf: str) -> DataFrame:
    return V.bags(V.sentence_words(corpus.works(spark, sf)), None, None, "plain")


@query(f"WITH {SENTENCES}, b AS (SELECT *, (sentence - 1) // 3 + 1 AS bundle FROM sentences) SELECT work_id, bundle::INT AS bundle, string_agg(array_to_string(words, ' '), ' ' ORDER BY sentence) AS bag FROM b GROUP BY work_id, bundle HAVING count(*) = 3")
def sentence_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return V.bundled(corpus.works(spark, sf), 3).select("work_id", "bundle", F.array_join("words", " ").alias("bag"))


@query(rf"WITH {LINES} SELECT work_id, idx, len(regexp_extract_all(line, '\p{{L}}+'))::INT AS runs, regexp_replace({BARE}, '[aeiou]', '', 'g') AS consonants FROM lines")
def letter_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("work_id", "idx", F.regexp_count("line", F.lit(r"\p{L}+")).cast("int").alias("runs"), F.regexp_replace(T.index_form(F.col("line")), "[aeiou]", "").alias("consonants"))


#: Lines of the corpus written with Greek letters, small and lunate sigmas, elision marks for commas, marks of another width; some letters stay Latin.
TO_GREEK = ("abcdefgilmnopqrstuwxyzABDEGILMNOPRSTU,?(){}é'", "αβχδεφγιλμνοπθρςτυωξηζΑΒΔΕΓΙΛΜΝΟΠΡϹΤΥ’﹖❨❩❴❵ὰ﹡")
_GREEK_LINES = f"{LINES}, greek AS (SELECT work_id, idx, translate(line, {quoted(TO_GREEK[0])}, {quoted(TO_GREEK[1])}) AS t FROM lines)"
_USUAL = f"translate(t, {quoted(T.SMALL_MARKS[0])}, {quoted(T.SMALL_MARKS[1])})"


def _greek(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("work_id", "idx", F.translate("line", *TO_GREEK).alias("t"))


@query(rf"""WITH {_GREEK_LINES} SELECT work_id, idx, translate(t, 'σςΣ', 'ϲϲϹ') AS lunate, regexp_replace(translate(translate(t, 'σςΣ', 'ϲϲϹ'), 'ϲϹ', 'σΣ'), 'σ([^\p{{L}}]|$)', 'ς\1', 'g') AS sigmas, {_USUAL} AS usual,
  regexp_replace(t, '([\s>])ς\.', '\1σ.', 'g') AS abbreviated,
  array_to_string(list_transform(regexp_extract_all(t, '\p{{Greek}}+|\p{{Latin}}+'), lambda r: CASE WHEN regexp_matches(r, '^\p{{Greek}}') THEN 'greek ' ELSE 'latin ' END || r), '|') AS runs FROM greek""")
def greek_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    runs = F.array_join(F.transform(T.script_runs(t), lambda r: F.concat_ws(" ", r["script"], r["run"])), "|")
    return _greek(spark, sf).select("work_id", "idx", T.lunate(t).alias("lunate"), T.differentiated_sigma(T.lunate(t)).alias("sigmas"), T.usual_marks(t).alias("usual"), T.inner_sigma_abbreviated(t).alias("abbreviated"), runs.alias("runs"))


@query(rf"""WITH {_GREEK_LINES}, parts AS (SELECT work_id, idx, list_filter(string_split(replace(t, chr(160), ' '), ' '), lambda w: w <> '') AS ws, list_filter(string_split(replace(regexp_replace(t, '<[^>]*>', '', 'g'), chr(160), ' '), ' '), lambda w: w <> '') AS shown FROM greek),
each AS (SELECT work_id, idx, shown, unnest(ws) AS w FROM parts), formed AS (SELECT work_id, idx, {bare('w')} || CASE WHEN regexp_matches(w, '[\x{{370}}-\x{{3ff}}\x{{1f00}}-\x{{1fff}}]') AND list_contains(shown, regexp_replace(lower(w), '[\p{{P}}\p{{S}}0-9{T.INDEX_MARKS}]', '', 'g') || '’') THEN chr(39) ELSE '' END AS word FROM each)
SELECT work_id, idx, word, count(*)::BIGINT AS n FROM formed WHERE word <> '' GROUP BY ALL""")
def index_tokens_greek(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of Greek lines: elided words keep their mark, graves become acutes."""
    rows = _greek(spark, sf).select("work_id", "idx", F.explode(T.index_tokens(F.col("t"))).alias("word"))
    return rows.groupBy("work_id", "idx", "word").agg(F.count("*").alias("n"))


#: Abbreviations of the corpus' own short words, in place of the Latin ones.
_POINTS = {"la.": "laudat", "is.": "ista", "the.": "thesis", "un.": "unus", "et.": "etiam", "und.": "undique", "of.": "officium", "that.": "thalamus"}
_MAP = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in _POINTS.items()) + "}"


@query(f"WITH {LINES}, t AS (SELECT work_id, idx, line AS t FROM lines) SELECT work_id, idx, {_WHOLE.replace(_WRITTEN_OUT, _MAP)} AS line FROM t")
def pointed_words_written_out(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("work_id", "idx", T.expanded_points(F.col("line"), _POINTS).alias("line"))


def _insertions(kind: str) -> str:
    """One family's insertions by windows and patterns: what is open before a line, then what stands up to the first closing bracket, then the rest."""
    a, b = (rf"\{c}" if c.isascii() else c for c in T.BRACKETS[kind])
    wrapped = rf'{a[-1]}<span class="{kind}">\1</span>\2'
    spanned = rf"'{a}([^{b}]*)({b}|$)', '{wrapped}', 'g'"
    head = f"regexp_extract(line, '^[^{b}]*')"
    return rf"""SELECT '{kind}' AS kind, work_id, idx, CASE WHEN begun THEN '<span class="{kind}">' || {head} || '</span>' || regexp_replace(substr(line, len({head}) + 1), {spanned}) ELSE regexp_replace(line, {spanned}) END AS line
FROM (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '{a}[^{b}]*$') THEN 1 WHEN regexp_matches(line, '{b}') THEN 0 END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR regexp_matches(line, '^[^{a}{b}]*{b}') AS begun FROM marked)"""


#: Commas and semicolons as brackets that change with the line's number, so that many stay open over lines.
_BRACKETED = f"{LINES}, marked AS (SELECT work_id, idx, translate(line, ',;', CASE WHEN idx % 3 = 0 THEN ')]' WHEN idx % 3 = 1 THEN '([' ELSE '⟨⟩' END) AS line FROM lines)"


@query(f"WITH {_BRACKETED} " + " UNION ALL ".join(_insertions(k) for k in ("square", "round", "angled")))
def editorial_insertions(spark: SparkSession, sf: str) -> DataFrame:
    """Spans around what editors put in, family by family, open brackets carried over the lines of a work."""
    marks = lambda i: F.when((i + 1) % 3 == 0, ")]").when((i + 1) % 3 == 1, "([").otherwise("⟨⟩")
    turned = corpus.works(spark, sf).withColumn("lines", F.transform("lines", lambda line, i: F.call_function("translate", line, F.lit(",;"), marks(i))))
    found = None
    for kind in ("square", "round", "angled"):
        rows = turned.select("work_id", F.posexplode(W.editorial_insertions(spark, F.col("lines"), (kind,))).alias("pos", "x")).select(F.lit(kind).alias("kind"), "work_id", (F.col("pos") + 1).alias("idx"), "x.line")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("SELECT page_id, array_to_string(list_transform(string_split(replace(replace(html, '<', chr(1) || '<'), '>', '>' || chr(1)), chr(1)), lambda p: CASE WHEN starts_with(p, '<') THEN p ELSE replace(p, 'an', '<b>an</b>') END), '') AS html FROM pages")
def highlighted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Matches marked in text, never in tags nor over them."""
    return corpus.table(spark, sf, "pages").select("page_id", T.highlight_outside_markup(F.col("html"), "an").alias("html"))


@query(rf"WITH {LINES} SELECT work_id, idx, regexp_replace(line, '[\p{{P}}\p{{S}}]', '', 'g') AS bare, len(regexp_extract_all(line, '\p{{Greek}}+|\p{{Latin}}+'))::INT AS runs FROM lines")
def script_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("line")
    return _lines(spark, sf).select("work_id", "idx", T.depunct(c).alias("bare"), F.size(T.script_runs(c)).alias("runs"))


@query("SELECT DISTINCT p_name, translate(lower(p_name), '" + "', '".join(T.BETA_LETTERS) + "') AS greek FROM part")
def beta_code_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names read as beta code. The conversion is Python, a batch of distinct names at a time."""
    from ..shipping import ship

    ship(spark)
    names = corpus.table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", T.beta_to_greek_column("p_name").alias("greek"))


@query("SELECT page_id, array_to_string(list_transform(string_split(replace(replace(html, '<', chr(1) || '<'), '>', '>' || chr(1)), chr(1)), lambda p: CASE WHEN starts_with(p, '<') THEN p ELSE translate(p, 'vV', 'uU') END), '') AS html FROM pages")
def u_for_v_pages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "pages").select("page_id", T.u_for_v_outside_markup(F.col("html")).alias("html"))


_ACCENTED = f"WITH {LINES}, words AS (SELECT DISTINCT unnest(string_split(replace(lower(line), chr(160), ' '), ' ')) AS word FROM lines)"


@query(f"{_ACCENTED} SELECT word, left(word, greatest(len(word) - 2, 0)) || translate(right(word, 2), {quoted(T.accent_pairs()[0])}, {quoted(T.accent_pairs()[1])}) AS acute FROM words WHERE word <> ''")
def graves_at_the_end(spark: SparkSession, sf: str) -> DataFrame:
    """Words with graves on their last two letters as they stand in a dictionary."""
    words = _lines(spark, sf).select(F.explode(T.tokens(F.lower("line"))).alias("word")).distinct()
    return words.select("word", T.grave_to_acute(F.col("word")).alias("acute"))


@query(rf"WITH {LINES} SELECT work_id, idx FROM lines WHERE regexp_matches(lower(line), '(^|\s)l[áà](\s|$)|(^|\s)[uv]n(\s|$)|(^|\s)whst(\s|$)')")
def word_list_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with any of some whole words, either accent and either of u and v."""
    return S.simple(corpus.works(spark, sf), T.word_list_pattern(["là", "vn", "whst"])).select("work_id", "idx")


@query(f"WITH {LINES} SELECT work_id, idx FROM lines WHERE contains(lower(line), 'whst')")
def either_case_search(spark: SparkSession, sf: str) -> DataFrame:
    return S.simple(corpus.works(spark, sf), T.either_case("Whst"), form=lambda line: line).select("work_id", "idx")


@query("SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), '|') AS notes FROM pages")
def annotated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Values of inline annotations: the pages' links written as such."""
    marked = F.regexp_replace("html", 'href="([^"]*)"', '><hmu_metadata_notes value="$1" /><')
    return corpus.table(spark, sf, "pages").select("page_id", F.array_join(T.annotations(marked), "|").alias("notes"))


@query("""WITH l AS (SELECT page_id, unnest(string_split(html, '.')) AS part, (generate_subscripts(string_split(html, '.'), 1))::INT AS idx FROM pages), n AS (SELECT *, len(regexp_extract_all(part, '<p>')) AS o, len(regexp_extract_all(part, '</p>')) AS c FROM l)
SELECT page_id, idx, repeat('<span>', greatest(c - o, 0)) || replace(replace(part, '<p>', '<span>'), '</p>', '</span>') || repeat('</span>', greatest(o - c, 0)) AS line FROM n""")
def balanced_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = corpus.table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "[.]")).alias("pos", "part"))
    spans = F.replace(F.replace("part", F.lit("<p>"), F.lit("<span>")), F.lit("</p>"), F.lit("</span>"))
    return parts.select("page_id", (F.col("pos") + 1).alias("idx"), T.balanced_spans(spans).alias("line"))


@query("SELECT source AS author, bit_or(CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 4 WHEN 'fr' THEN 8 ELSE 0 END)::INT AS mask, bool_and(lang = 'en') AS english FROM documents GROUP BY source")
def corpora_of_authors(spark: SparkSession, sf: str) -> DataFrame:
    """The corpora that an author's works are in, as bits, and whether that is one alone."""
    rows = corpus.works_catalog(spark, sf).groupBy("author").agg(F.collect_set("corpus").alias("corpora"))
    return rows.select("author", mask_of(F.col("corpora")).alias("mask"), are_only(F.col("corpora"), ("en",)).alias("english"))


@query("WITH known AS (SELECT r_name AS language, substr(n_name, 1, 3) || n_nationkey AS abbreviation, n_name AS author FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3), asked AS (SELECT s_suppkey, r_name AS language, substr(n_name, 1, 3) || n_nationkey AS abbreviation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT s_suppkey, coalesce(author, abbreviation) AS author FROM asked LEFT JOIN known USING (language, abbreviation)")
def authors_by_abbreviation(spark: SparkSession, sf: str) -> DataFrame:
    nation = corpus.table(spark, sf, "nation").join(corpus.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    short = F.concat(F.substring("n_name", 1, 3), F.col("n_nationkey").cast("string"))
    known = nation.where("n_regionkey < 3").select(F.col("r_name").alias("language"), short.alias("abbreviation"), F.col("n_name").alias("author"))
    asked = corpus.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("language"), short.alias("abbreviation"))
    return P.authors_in_full(asked, known).select("s_suppkey", "author")

"""Selections of passages, browsing by citation, and hints while typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import walks as W
from ..operators import browse as B
from ..operators import scope as P
from ..plans import selection as E
from ..registry import query
from ..sources import corpus
from .scoping import _CITED
from .sql import CATALOG

#: Passages and spans of some works.
CHOSEN = ["src1w1_AT_2", "src1w1_AT_1|3", "src3w3_AT_1", "src3w3_FROM_2_TO_4", "src7w7_FROM_1_TO_3", "src7w7_AT_99", "src12w12_AT_3|2"]
_CHOSEN = "chosen(selection) AS (VALUES " + ", ".join(f"('{c}')" for c in CHOSEN) + ")"
_BOUNDS = f"""{_CITED.rstrip()}, {_CHOSEN}, named AS (SELECT selection, regexp_extract(selection, 'w(\\d+)_', 1)::BIGINT AS work_id, string_split(regexp_extract(selection, '_AT_(.*)$', 1), '|') AS levels FROM chosen),
bounds AS (SELECT selection, c.work_id, min(idx)::INT AS first, max(idx)::INT AS last FROM named n JOIN cited c ON c.work_id = n.work_id AND c.l1::VARCHAR = levels[1] AND (len(levels) < 2 OR c.l0::VARCHAR = levels[2]) WHERE selection LIKE '%\\_AT\\_%' ESCAPE '\\' GROUP BY selection, c.work_id
  UNION ALL SELECT selection, work_id, regexp_extract(selection, '_FROM_(\\d+)', 1)::INT, regexp_extract(selection, '_TO_(\\d+)', 1)::INT FROM named WHERE selection LIKE '%\\_FROM\\_%' ESCAPE '\\')"""


def _chosen(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CHOSEN], "selection string")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    return B.cited_lines(corpus.works(spark, sf))


@query(_BOUNDS + " SELECT * FROM bounds")
def passage_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return E.boundaries(_chosen(spark), _cited(spark, sf))


@query(_BOUNDS + " SELECT DISTINCT c.work_id, c.idx, c.line FROM cited c JOIN bounds b ON b.work_id = c.work_id AND c.idx BETWEEN first AND last")
def selected_passages(spark: SparkSession, sf: str) -> DataFrame:
    lines = _cited(spark, sf)
    return P.within_ranges(lines.select("work_id", "idx", "line"), E.boundaries(_chosen(spark), lines).select("work_id", "first", "last"))


@query(_CITED + "SELECT work_id, idx, line FROM cited WHERE author = 'src3' AND work_id = 3 AND l1 = 1")
def text_of_a_passage(spark: SparkSession, sf: str) -> DataFrame:
    return E.text_of({"author": "src3", "work": "3", "locus": "1"}, _cited(spark, sf)).select("work_id", "idx", "line")


@query(_CITED + "SELECT work_id, idx, line FROM cited WHERE author = 'src3' AND work_id = 3 AND idx BETWEEN 2 AND 4")
def text_of_a_span(spark: SparkSession, sf: str) -> DataFrame:
    return E.text_of({"author": "src3", "work": "3", "locus": "2", "endpoint": "4"}, _cited(spark, sf)).select("work_id", "idx", "line")


@query(f"WITH {CATALOG} SELECT author || CASE WHEN work_id IN (1, 3, 12) THEN 'x' ELSE 'w' END || work_id AS scope_id FROM catalog")
def flagged_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    ids = corpus.works_catalog(spark, sf).select(F.concat("author", F.lit("w"), F.col("work_id").cast("string")).alias("scope_id"))
    named = corpus.works_catalog(spark, sf).where("work_id in (1, 3, 12)").select(F.concat("author", F.lit("w"), F.col("work_id").cast("string"), F.lit("_AT_1")).alias("passage"))
    return E.flagged(ids, named)


@query(f"WITH {CATALOG}, s AS (SELECT DISTINCT author FROM catalog WHERE corpus = 'de' OR author < 'src2'), a AS (SELECT DISTINCT corpus, author FROM catalog) SELECT corpus, count(*) = count(s.author) AS whole FROM a LEFT JOIN s USING (author) GROUP BY corpus")
def whole_corpora(spark: SparkSession, sf: str) -> DataFrame:
    catalog = corpus.works_catalog(spark, sf)
    return E.whole_corpora(catalog, catalog.where("corpus = 'de' or author < 'src2'").select(F.col("author").alias("scope_id")).distinct())


@query(f"WITH {CATALOG} SELECT corpus IN ('en', 'fr') AS literary, count(*)::BIGINT AS works FROM catalog GROUP BY 1")
def literary_works(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.works_catalog(spark, sf).groupBy(E.is_literary(F.col("corpus")).alias("literary")).agg(F.count("*").alias("works"))


@query(f"WITH {CATALOG} SELECT DISTINCT corpus, trim(regexp_replace(unnest(string_split('shelf ' || place_key || ', room ' || (work_id % 3) || ' [lost]', ',')), '\\[[^\\]]*\\]', '', 'g')) AS value FROM catalog")
def facets_provenance(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.works_catalog(spark, sf).select("corpus", F.concat(F.lit("shelf "), F.col("place_key").cast("string"), F.lit(", room "), (F.col("work_id") % 3).cast("string"), F.lit(" [lost]")).alias("provenance"))
    return P.facets(rows, ["corpus"], "provenance")


@query(f"WITH {CATALOG} SELECT DISTINCT 'genre' AS kind, trim(unnest(string_split(genre, ','))) AS value FROM catalog UNION SELECT DISTINCT 'place', location FROM authors")
def genre_list(spark: SparkSession, sf: str) -> DataFrame:
    catalog = corpus.works_catalog(spark, sf)
    genres = P.facets(catalog.select(F.lit("genre").alias("kind"), "genre"), ["kind"], "genre")
    places = P.facets(corpus.authors(catalog).select(F.lit("place").alias("kind"), "location"), ["kind"], "location")
    return genres.unionByName(places)


@query(f"WITH {CATALOG} SELECT work_id, corpus, author, (row_number() OVER (ORDER BY corpus, coalesce(eff, 9999), author, work_id))::INT AS place FROM dated WHERE genre LIKE '%epic%' ORDER BY place LIMIT 500")
def sorted_search_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 works of a scope as they will be searched and shown."""
    from ..operators.search import capped

    catalog = corpus.works_catalog(spark, sf)
    works = P.compile_scope(catalog, corpus.authors(catalog), P.Scope(genres=("epic",)))
    rows = works.select("work_id", "corpus", "author", F.coalesce("date", "author_date", F.lit(9999)).alias("year"))
    return capped(rows, 500, ["corpus", "year", "author", "work_id"]).select("work_id", "corpus", "author", F.col("number").alias("place"))


@query(_CITED + "SELECT work_id, l0::VARCHAR AS value, min(idx)::INT AS first, max(idx)::INT AS last, (row_number() OVER (PARTITION BY work_id ORDER BY l0))::INT AS place FROM cited WHERE l1 = 2 GROUP BY work_id, l0")
def lower_level_values(spark: SparkSession, sf: str) -> DataFrame:
    return B.level_values(_cited(spark, sf), l1=2)


@query(_CITED + "SELECT work_id, 'section' AS label, min(l1)::VARCHAR AS low, max(l1)::VARCHAR AS high, count(DISTINCT l1)::BIGINT AS values FROM cited GROUP BY work_id")
def work_structure(spark: SparkSession, sf: str) -> DataFrame:
    return B.structure(_cited(spark, sf), {"l1": "section", "l0": "line"})


@query(_CITED + "SELECT work_id, 'line' AS label, min(l0)::VARCHAR AS low, max(l0)::VARCHAR AS high, count(DISTINCT l0)::BIGINT AS values FROM cited WHERE l1 = 1 GROUP BY work_id")
def section_structure(spark: SparkSession, sf: str) -> DataFrame:
    return B.structure(_cited(spark, sf), {"l1": "section", "l0": "line"}, l1=1)


#: What is asked, of which work, the citation as written, its levels
CITATIONS = [(1, 1, "1.2", "1 2"), (2, 3, "bk. 2, l. 3-7", "2 3"), (3, 7, "1:9:4", "1 9 4"), (4, 7, "sec. 2", "2"), (5, 12, "99.1", "99 1"), (6, 13, "", ""), (7, 9, "(3,1)", "3 1"), (8, 11, "1.1-2.4", "1 1 4")]
_CITATIONS = "asked(ask, work_id, citation, c) AS (SELECT ask, work_id, citation, list_filter(string_split(levels, ' '), lambda x: x <> '') FROM (VALUES " + ", ".join(f"({k}, {w}, '{c}', '{x}')" for k, w, c, x in CITATIONS) + ") v(ask, work_id, citation, levels))"
_PLACES = f"""{_CITED.rstrip()}, {_CITATIONS}, tries AS (
  SELECT ask, work_id, 1 AS rung, c[1] AS a, c[2] AS b FROM asked WHERE len(c) = 2 UNION ALL SELECT ask, work_id, 2, c[1], c[3] FROM asked WHERE len(c) > 2 UNION ALL SELECT ask, work_id, 3, c[1], NULL FROM asked WHERE len(c) >= 1),
found AS (SELECT t.ask, t.work_id, t.rung, min(l.idx) AS idx FROM tries t JOIN cited l ON l.work_id = t.work_id AND l.l1::VARCHAR = a AND (b IS NULL OR l.l0::VARCHAR = b) GROUP BY ALL
  UNION ALL SELECT ask, a.work_id, 4, min(l.idx) FROM asked a JOIN cited l ON l.work_id = a.work_id GROUP BY ALL),
places AS (SELECT ask, work_id, arg_min(idx, rung)::INT AS idx, min(rung)::INT AS rung FROM found GROUP BY ask, work_id)"""


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = _cited(spark, sf)
    return B.resolve_citations(spark.createDataFrame([c[:3] for c in CITATIONS], "ask int, work_id long, citation string"), lines), lines


@query("SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN concat_ws(' ', doc_id % 7, n_chars % 9, doc_id % 5) ELSE concat_ws(' ', doc_id % 7, n_chars % 9) END AS levels FROM documents")
def foreign_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations as others write them, made of the works' numbers: points, labels and ranges, colons, brackets."""
    rows = corpus.table(spark, sf, "documents")
    a, b, c = (F.col(x).cast("string") for x in ("a", "b", "c"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat_ws(".", a, b)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("bk. "), a, F.lit(", l. "), b, F.lit("-"), c)).when(F.col("doc_id") % 4 == 2, F.concat_ws(":", a, b, c)).otherwise(F.concat(F.lit("("), a, F.lit(","), b, F.lit(")")))
    rows = rows.select("doc_id", (F.col("doc_id") % 7).alias("a"), (F.col("n_chars") % 9).alias("b"), (F.col("doc_id") % 5).alias("c"))
    return rows.select("doc_id", F.array_join(B.foreign_levels(text), " ").alias("levels"))


@query(_PLACES + " SELECT * FROM places")
def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf)[0]


@query(_PLACES + " SELECT p.ask, p.work_id, p.idx AS at, l.idx, l.line FROM places p JOIN lines l ON l.work_id = p.work_id AND abs(l.idx - p.idx) <= 3")
def browse_citations(spark: SparkSession, sf: str) -> DataFrame:
    return B.around(*_places(spark, sf), 3)


#: Tags of a line as marks: a class (or none) for an opening one, a slash for a closing one; a stack is a text of marks.
_MARKS = r"""list_transform(regexp_extract_all(part, '<(/?)p\b([^>]*)>'), lambda m: CASE WHEN starts_with(m, '</') THEN '/' ELSE '|' || regexp_extract(m, 'class="([^"]*)"', 1) END)"""
_STACK = "list_reduce(list_prepend('', flatten(list(marks) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND {upto}))), lambda s, m: CASE WHEN m = '/' THEN regexp_replace(s, '[|][^|]*$', '') ELSE s || m END)"


@query(rf"""WITH l AS (SELECT page_id, unnest(string_split(html, '.')) AS part, (generate_subscripts(string_split(html, '.'), 1))::INT AS idx FROM pages),
m AS (SELECT *, {_MARKS} AS marks FROM l), s AS (SELECT page_id, idx, part, coalesce({_STACK.format(upto='1 PRECEDING')}, '') AS before, {_STACK.format(upto='CURRENT ROW')} AS after FROM m)
SELECT page_id, idx, regexp_replace(regexp_replace(before, '[|]([^|]+)', '<p class="\1">', 'g'), '[|]', '<p>', 'g') || part || repeat('</p>', len(regexp_extract_all(after, '[|]'))) AS line, before, after FROM s""")
def carried_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages cut at points, each part's paragraphs made whole: what is open is opened again with its class."""
    rows = corpus.table(spark, sf, "pages").select("page_id", F.posexplode(W.carried_spans(spark, F.split("html", "[.]"), "p")).alias("pos", "x"))
    stack = lambda c: F.array_join(F.transform(c, lambda name: F.concat(F.lit("|"), name)), "")
    return rows.select("page_id", (F.col("pos") + 1).alias("idx"), "x.line", stack("x.before").alias("before"), stack("x.after").alias("after"))


@query(f"{_CITED.rstrip()}, e AS (SELECT work_id, idx, l1, CASE WHEN regexp_matches(line, '\\([^)]*$') THEN 1 WHEN regexp_matches(line, '^[^(]*\\)') THEN 0 END AS event FROM cited) SELECT work_id, idx, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY work_id, l1 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INT AS open FROM e")
def bracket_carry_over_by_section(spark: SparkSession, sf: str) -> DataFrame:
    return B.bracket_state(corpus.works(spark, sf), per_section=5).select("work_id", "idx", "open")


@query("SELECT DISTINCT c_name FROM customer WHERE starts_with(lower(c_name), 'customer#00000') ORDER BY c_name LIMIT 50")
def autocomplete_capped(spark: SparkSession, sf: str) -> DataFrame:
    return B.autocomplete(corpus.table(spark, sf, "customer"), "c_name", "CUSTOMER#00000")


@query("SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN '[' || p_name || ']' ELSE p_name END AS name FROM part WHERE starts_with(p_name, 'small') ORDER BY 1 LIMIT 50")
def autocomplete_bracketed(spark: SparkSession, sf: str) -> DataFrame:
    names = corpus.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), "p_name", F.lit("]"))).otherwise(F.col("p_name")).alias("name"))
    return B.autocomplete(names, "name", "small")


@query("SELECT DISTINCT p_name || ' ' || p_partkey AS entry FROM part WHERE starts_with(translate(lower(p_name), 'vj', 'ui'), 'red') ORDER BY 1 LIMIT 50")
def lemma_hints(spark: SparkSession, sf: str) -> DataFrame:
    entries = corpus.table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("entry"))
    return B.lemma_hints(entries, "entry", "Red")


@query("SELECT DISTINCT s_name || ' [' || s_suppkey || ']' AS hint FROM supplier WHERE starts_with(lower(s_name), 'supplier#0000000') ORDER BY 1 LIMIT 50")
def author_hints(spark: SparkSession, sf: str) -> DataFrame:
    return B.labelled_hints(corpus.table(spark, sf, "supplier"), "s_name", "s_suppkey", "Supplier#0000000")


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 's')")
def dictionary_part(spark: SparkSession, sf: str) -> DataFrame:
    return B.starting_with(corpus.table(spark, sf, "part"), "p_name", "s")

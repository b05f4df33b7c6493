"""Scope algebra and citation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import scope as P
from ..registry import query
from ..sources import corpus
from .sql import CATALOG, LINES


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    catalog = corpus.works_catalog(spark, sf)
    return catalog, corpus.authors(catalog)


def _scope(spark: SparkSession, sf: str, **what) -> DataFrame:
    catalog, authors = _catalog(spark, sf)
    return P.compile_scope(catalog, authors, P.Scope(**what)).select("work_id", "title")


@query(f"WITH {CATALOG} SELECT corpus, author, work_id, title, genre, date, place_key, size FROM catalog")
def works_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.works_catalog(spark, sf)


@query(f"WITH {CATALOG} SELECT d.author, author_date, location, count(*)::BIGINT AS works, sum(size)::BIGINT AS size FROM dated d GROUP BY ALL")
def works_by_author(spark: SparkSession, sf: str) -> DataFrame:
    catalog, authors = _catalog(spark, sf)
    return catalog.join(authors, "author").groupBy("author", "author_date", "location").agg(F.count("*").alias("works"), F.sum("size").alias("size"))


@query(f"WITH {CATALOG} SELECT work_id, title FROM dated WHERE corpus IN ('en', 'fr') AND (genre LIKE '%epic%' OR genre LIKE '%hist%') AND (eff IS NULL OR eff BETWEEN -400 AND 100 OR eff = 2000) AND NOT coalesce(eff = 2500, false) AND NOT regexp_matches(title, '\\[[Ss]p\\.\\]')")
def scope_corpus_genre_date(spark: SparkSession, sf: str) -> DataFrame:
    return _scope(spark, sf, corpora=("en", "fr"), genres=("epic", "hist"), earliest=-400, latest=100, uncertain=False, spurious=False)


@query(f"WITH {CATALOG} SELECT work_id, title FROM dated WHERE list_contains(string_split(genre, ','), 'phil') AND author <> 'src3' AND work_id NOT IN (11, 12)")
def scope_exact_genre_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return _scope(spark, sf, genres=("phil",), exact_genres=True, without_authors=("src3",), without_works=(11, 12))


@query(f"WITH {CATALOG} SELECT work_id, title FROM dated WHERE (author IN ('src1', 'src2') OR work_id IN (5, 40)) AND (NOT coalesce(eff = 2000, false) OR author IN ('src1', 'src2') OR work_id IN (5, 40)) AND (NOT regexp_matches(title, '\\[[Ss]p\\.\\]') OR work_id IN (5, 40))")
def scope_explicit_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _scope(spark, sf, authors=("src1", "src2"), works=(5, 40), various=False, spurious=False)


@query(f"WITH {CATALOG} SELECT work_id, 'various' AS kind FROM dated WHERE eff IS NULL OR eff = 2000 UNION ALL SELECT work_id, 'uncertain' FROM dated WHERE eff IS NULL OR eff = 2500")
def sentinel_works(spark: SparkSession, sf: str) -> DataFrame:
    catalog, authors = _catalog(spark, sf)
    rows = catalog.join(authors, "author", "left")
    kinds = F.array(F.when(P.sentinel(F.col("date"), F.col("author_date"), P.VARIOUS), "various"), F.when(P.sentinel(F.col("date"), F.col("author_date"), P.UNCERTAIN), "uncertain"))
    return rows.select("work_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


@query(f"WITH {CATALOG}, chosen AS (SELECT author, work_id FROM catalog WHERE author IN ('src0', 'src1') OR work_id % 2 = 0), t AS (SELECT author, count(*) AS total FROM catalog GROUP BY author), n AS (SELECT author, count(*) AS n FROM chosen GROUP BY author) SELECT DISTINCT CASE WHEN n = total THEN author ELSE author || 'w' || work_id END AS scope_id FROM chosen JOIN n USING (author) JOIN t USING (author)")
def scope_whole_author(spark: SparkSession, sf: str) -> DataFrame:
    catalog, _ = _catalog(spark, sf)
    return P.whole_authors(catalog, catalog.where(F.col("author").isin("src0", "src1") | (F.col("work_id") % 2 == 0)))


@query(f"WITH {LINES}, r AS (SELECT doc_id AS work_id, (doc_id % 3 + 1)::INT AS first, (doc_id % 3 + 4)::INT AS last FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id AS work_id, 3 AS first, 3 AS last FROM documents WHERE doc_id % 4 = 0) SELECT work_id, idx, line FROM lines l WHERE EXISTS (SELECT 1 FROM r WHERE r.work_id = l.work_id AND l.idx BETWEEN first AND last) AND NOT EXISTS (SELECT 1 FROM o WHERE o.work_id = l.work_id AND l.idx BETWEEN first AND last)")
def scope_ranges_minus_omissions(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf)).select("work_id", "idx", "line")
    ids = corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"))
    ranges = ids.where("work_id % 2 = 0").select("work_id", (F.col("work_id") % 3 + 1).cast("int").alias("first"), (F.col("work_id") % 3 + 4).cast("int").alias("last"))
    omitted = ids.where("work_id % 4 = 0").select("work_id", F.lit(3).alias("first"), F.lit(3).alias("last"))
    return P.within_ranges(lines, ranges, omitted)


@query(f"WITH {CATALOG} SELECT DISTINCT corpus, trim(unnest(string_split(genre, ','))) AS value FROM catalog")
def facets_genre(spark: SparkSession, sf: str) -> DataFrame:
    return P.facets(corpus.works_catalog(spark, sf), ["corpus"], "genre")


@query("SELECT DISTINCT r_name, trim(unnest(string_split(n_name || ', ' || r_name || ' [old]', ',')), ' ') AS value FROM nation JOIN region ON n_regionkey = r_regionkey".replace("trim(unnest(string_split(n_name || ', ' || r_name || ' [old]', ',')), ' ')", "trim(regexp_replace(unnest(string_split(n_name || ', ' || r_name || ' [old]', ',')), '\\[[^\\]]*\\]', '', 'g'))"))
def facets_location(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.table(spark, sf, "nation").join(corpus.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.facets(rows.select("r_name", F.concat("n_name", F.lit(", "), "r_name", F.lit(" [old]")).alias("places")), ["r_name"], "places")


@query(f"WITH {CATALOG} SELECT corpus, genre, count(*)::BIGINT AS works, sum(size)::BIGINT AS size, count(DISTINCT author)::BIGINT AS authors FROM catalog GROUP BY corpus, genre")
def scope_preview(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.works_catalog(spark, sf).groupBy("corpus", "genre").agg(F.count("*").alias("works"), F.sum("size").alias("size"), F.count_distinct("author").alias("authors"))


@query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT c_custkey AS author, 0::BIGINT AS works FROM m UNION ALL SELECT o_custkey, n::BIGINT FROM n WHERE n >= 20")
def catalog_extremes(spark: SparkSession, sf: str) -> DataFrame:
    orders = corpus.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("works"))
    none = corpus.table(spark, sf, "customer").select(F.col("c_custkey").alias("author")).join(orders, "author", "left_anti").select("author", F.lit(0).cast("long").alias("works"))
    return none.unionByName(orders.where("works >= 20"))


_CITED = f"WITH {LINES}, cited AS (SELECT *, ((idx - 1) // 5 + 1)::INT AS l1, ((idx - 1) % 5 + 1)::INT AS l0 FROM lines) "


@query(_CITED + "SELECT work_id, l1::VARCHAR AS value, min(idx)::INT AS first, max(idx)::INT AS last, (row_number() OVER (PARTITION BY work_id ORDER BY l1))::INT AS place FROM cited GROUP BY work_id, l1")
def citation_level_values(spark: SparkSession, sf: str) -> DataFrame:
    return B.level_values(B.cited_lines(corpus.works(spark, sf)))


@query(_CITED + "SELECT work_id, arg_min(l1 || '.' || l0, idx) AS low, arg_max(l1 || '.' || l0, idx) AS high FROM cited GROUP BY work_id")
def sample_citations(spark: SparkSession, sf: str) -> DataFrame:
    return B.sample_citations(B.cited_lines(corpus.works(spark, sf)))


@query(_CITED + "SELECT work_id, min(idx)::INT AS idx FROM cited WHERE l1 = 2 AND l0 = 3 GROUP BY work_id")
def resolve_full_locus(spark: SparkSession, sf: str) -> DataFrame:
    return B.resolve_locus(B.cited_lines(corpus.works(spark, sf)), l1=2, l0=3)


@query(_CITED + "SELECT work_id, max(idx)::INT AS idx FROM cited WHERE l1 = 2 GROUP BY work_id")
def resolve_incomplete_locus(spark: SparkSession, sf: str) -> DataFrame:
    return B.resolve_locus(B.cited_lines(corpus.works(spark, sf)), l1=2, last=True)


@query(_CITED + "SELECT idx, 'section ' || l1 || ', line ' || l0 AS locus, line FROM cited WHERE work_id = 7 AND idx BETWEEN 2 AND 9")
def browse_span(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.span(B.cited_lines(corpus.works(spark, sf)), 7, 2, 9)
    return rows.select("idx", B.prolix_locus(["section", "line"], [F.col("l1"), F.col("l0")]).alias("locus"), "line")


@query("WITH c AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, turn % 3 = 0 AS third, coalesce(lag(turn % 3 = 0) OVER w, false) AS third_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, coalesce(before <> role, true) AS changed, third AND NOT third_before AS shown FROM c")
def level_change_markers(spark: SparkSession, sf: str) -> DataFrame:
    return B.level_changes(corpus.table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", 3).select("conv_id", "turn", "changed", "shown")


@query("WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS v FROM conversations) SELECT conv_id, turn, last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM e")
def carried_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return B.carried(rows, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query(f"WITH {LINES}, e AS (SELECT work_id, idx, CASE WHEN regexp_matches(line, '\\([^)]*$') THEN 1 WHEN regexp_matches(line, '^[^(]*\\)') THEN 0 END AS event FROM lines) SELECT work_id, idx, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::INT AS open FROM e")
def bracket_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    return B.bracket_state(corpus.works(spark, sf)).select("work_id", "idx", "open")


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 's') ORDER BY p_name LIMIT 50")
def autocomplete_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return B.autocomplete(corpus.table(spark, sf, "part"), "p_name", "S")


@query("SELECT substr(lower(p_name), 1, 2) AS prefix, count(DISTINCT p_name)::BIGINT AS n, min(p_name) AS first FROM part GROUP BY ALL".replace("lower(p_name)", "translate(lower(p_name), 'vj', 'ui')"))
def dictionary_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return B.by_prefix(corpus.table(spark, sf, "part"), "p_name")

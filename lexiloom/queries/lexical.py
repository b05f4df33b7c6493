"""Dictionary and morphology queries over tables that stand in for a lexicon: parts as entries, tokens as forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concordance as C
from ..operators import lexicon as L
from ..registry import query
from ..sources import corpus
from .sql import TOKENS
from .statistics import tokens

_ENTRIES = "entries AS (SELECT p_partkey AS id, p_brand AS entry, p_type AS translations, p_size AS size FROM part), counts AS (SELECT l_partkey AS id, count(*)::BIGINT AS total FROM lineitem GROUP BY l_partkey)"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("translations"))


@query(f"WITH {_ENTRIES} SELECT id AS entry, translations, coalesce(total, 0)::BIGINT AS total, row_number() OVER (ORDER BY coalesce(total, 0) DESC, id) AS place FROM entries LEFT JOIN counts USING (id) WHERE regexp_matches(translations, '[A-E]')")
def reverse_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf).withColumnRenamed("id", "entry")
    counts = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entry")).agg(F.count("*").alias("total"))
    return L.reverse_lookup(entries, counts, "[A-E]")


@query("SELECT p_partkey AS id, p_brand || p_partkey AS entry, lag(p_brand || p_partkey) OVER (ORDER BY p_partkey) AS before, lead(p_brand || p_partkey) OVER (ORDER BY p_partkey) AS after FROM part")
def dictionary_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf).select("id", F.concat("brand", F.col("id").cast("string")).alias("entry"))
    return L.neighbours(entries)


@query("""WITH e AS (SELECT DISTINCT p_name AS entry FROM part UNION SELECT DISTINCT c_name FROM customer) SELECT 'whole' AS how, entry FROM e WHERE entry = 'small ring' UNION ALL SELECT 'start', entry FROM e WHERE starts_with(entry, 'small') UNION ALL
SELECT 'end', entry FROM e WHERE ends_with(entry, '7') UNION ALL SELECT 'within', entry FROM e WHERE contains(entry, '#00000001')""")
def headword_search(spark: SparkSession, sf: str) -> DataFrame:
    """All four anchorings of a term, over two lists of entries."""
    entries = corpus.table(spark, sf, "part").select(F.col("p_name").alias("entry")).union(corpus.table(spark, sf, "customer").select("c_name")).distinct()
    found = None
    for how, term in (("whole", " small ring "), ("start", " small"), ("end", "7 "), ("within", "#00000001")):
        rows = L.headword_search(entries, term).select(F.lit(how).alias("how"), "entry")
        found = rows if found is None else found.unionByName(rows)
    return found


_LADDER = """probes AS (SELECT term, 1 AS rung, term AS entry FROM asked UNION ALL SELECT term, 2, regexp_replace(term, '(es|s)$', '') FROM asked UNION ALL SELECT term, 3, regexp_replace(term, '(ed|ing)$', '') FROM asked),
p AS (SELECT term, entry, min(rung) AS rung FROM probes GROUP BY term, entry),
found AS (SELECT p.*, v.n FROM p JOIN v ON p.entry = v.word), best AS (SELECT term, min(rung) AS rung FROM found GROUP BY term)"""


@query(f"WITH {TOKENS}, v AS (SELECT word, count(*)::BIGINT AS n FROM tokens WHERE corpus = 'en' GROUP BY word), asked AS (SELECT DISTINCT word AS term FROM tokens), {_LADDER} SELECT term, rung::INT AS rung, entry, n FROM found JOIN best USING (term, rung)")
def morphology_ladder(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf)).select("corpus", F.explode(T.index_tokens(F.col("line"))).alias("word"))
    entries = lines.where("corpus = 'en'").groupBy(F.col("word").alias("entry")).agg(F.count("*").alias("n"))
    t = F.col("term")
    rewrites = [t, F.regexp_replace(t, "(es|s)$", ""), F.regexp_replace(t, "(ed|ing)$", "")]
    return L.ladder(lines.select(F.col("word").alias("term")).distinct(), entries, rewrites)


@query("WITH n AS (SELECT c_name AS entry, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_name) SELECT * FROM n")
def entries_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = corpus.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = corpus.table(spark, sf, "customer").select(F.col("c_name").alias("entry"), F.col("c_custkey"))
    counts = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("entry", "n")
    return L.with_counts(customers.select("entry"), counts)


#: a form's analysis drawn from its length and count, so that both engines agree
_ANALYSES = f"""{TOKENS}, c AS (SELECT word AS form, count(*)::BIGINT AS n FROM tokens GROUP BY word),
a AS (SELECT substr(form, 1, 5) AS headword, form, n, CASE len(form) % 3 WHEN 0 THEN 'masc/fem' WHEN 1 THEN 'fem' ELSE 'neut' END AS g, CASE n % 3 WHEN 0 THEN 'nom/acc' WHEN 1 THEN 'gen' ELSE 'dat' END AS cs, CASE WHEN n % 2 = 0 THEN 'sg' ELSE 'pl' END AS nb FROM c)"""


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.word_counts(tokens(spark, sf)).withColumnRenamed("word", "form")
    size = F.char_length("form") % 3
    gender = F.when(size == 0, "masc/fem").when(size == 1, "fem").otherwise("neut")
    case = F.when(F.col("n") % 3 == 0, "nom/acc").when(F.col("n") % 3 == 1, "gen").otherwise("dat")
    return counts.select(F.substring("form", 1, 5).alias("headword"), "form", "n", F.concat_ws(" ", gender, case, F.when(F.col("n") % 2 == 0, "sg").otherwise("pl")).alias("analysis"))


_CELL = lambda g: f"coalesce(string_agg(form || ' (' || n || ')', ' / ' ORDER BY form) FILTER (gender = '{g}'), '---') AS {g}"


@query(f"WITH {_ANALYSES}, x AS (SELECT headword, form, n, unnest(string_split(g, '/')) AS gender, cs, nb FROM a), y AS (SELECT headword, form, n, gender, unnest(string_split(cs, '/')) AS case_, nb AS number FROM x) SELECT headword, case_ AS \"case\", number, {_CELL('masc')}, {_CELL('fem')}, {_CELL('neut')} FROM y GROUP BY headword, case_, number")
def declension_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return L.declension(_analyses(spark, sf), ["masc", "fem", "neut"], ["nom", "gen", "dat", "acc"], ["sg", "pl"])


@query("SELECT o_orderpriority AS headword, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) > 0 AS conjugated FROM orders GROUP BY 1")
def mostly_conjugated(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "fut ind act 3rd sg (epic)").otherwise("masc nom sg")
    return L.mostly_conjugated(corpus.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("headword"), kind.alias("analysis")))


_TAG = lambda t: f"list_distinct(regexp_extract_all(html, '<{t}\\b[^>]*>([^<]*)</{t}>', 1))"


@query(f"SELECT page_id, array_to_string(list_sort({_TAG('a')}), '|') AS senses, array_to_string(list_sort(list_filter({_TAG('b')}, lambda q: NOT list_contains({_TAG('li')}, q))), '|') AS quotes, array_to_string(list_sort({_TAG('h1')}), '|') AS authors FROM pages")
def entry_summaries(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("html")
    for tag, name in (("a", "sense"), ("li", "orth"), ("b", "quote"), ("h1", "author")):  # the pages' tags as an entry's
        body = F.regexp_replace(body, rf"<(/?){tag}\b", f"<$1{name}")
    found = L.entry_summaries(body)
    return corpus.table(spark, sf, "pages").select("page_id", *(F.array_join(found[c], "|").alias(c) for c in ("senses", "quotes", "authors")))

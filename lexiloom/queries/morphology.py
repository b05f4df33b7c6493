"""Morphology and dictionary queries. Analyses, compounds and entries are made of the corpus' own words by rules that both engines state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import concordance as C
from ..operators import lexicon as L
from ..operators import morphology as M
from ..registry import query
from ..sources import corpus
from .searching import FORMS
from .sql import TOKENS, index_words
from .statistics import tokens

#: Analyses that words of the corpus get, by their letters and length; words of even length get two.
KINDS = [
    "pres ind act 1st sg", "pres ind act 2nd sg", "pres ind act 3rd sg", "pres inf act", "perf ind act 1st sg", "perf part pass masc nom sg", "perf part pass fem nom/voc sg", "pres ind pass 1st pl", "fut ind act 1st sg",
    "imperf ind act 1st sg (early)", "pres subj act 3rd sg", "pres imperat act 2nd sg", "masc/fem nom/voc sg", "masc/fem gen sg", "masc/fem acc sg", "masc/fem nom/acc/voc pl", "masc/fem dat/abl pl", "neut nom/acc/voc sg",
    "neut dat/abl pl", "neut gen sg (attic epic)", "pres ind pass 3rd sg", "pres ind mp 1st sg (ionic)", "aor ind mid 3rd sg",
]
_AN = f"""{TOKENS}, an AS (SELECT substr(word, 1, 4) AS headword, word AS form, unnest(CASE WHEN len(word) % 2 = 0 THEN [kinds[k + 1], kinds[(k + 9) % {len(KINDS)} + 1]] ELSE [kinds[k + 1]] END) AS analysis, n
  FROM (SELECT word, count(*)::INT AS n, (ascii(right(word, 1)) + 7 * len(word) + ascii(substr(word, 2, 1))) % {len(KINDS)} AS k, [{", ".join(f"'{x}'" for x in KINDS)}] AS kinds FROM tokens WHERE regexp_matches(word, '^[a-z]{{4,}}$') GROUP BY word))"""
_A = _AN + r""", a AS (SELECT *, string_split(trim(regexp_replace(analysis, '\([^)]*\)', '')), ' ') AS parts, string_split_regex(trim(regexp_replace(analysis, '\([^)]*\)', '')), '[ /]') AS w,
  CASE WHEN analysis LIKE '%(%' THEN string_split(regexp_extract(analysis, '\(([^)]*)\)', 1), ' ') ELSE ['common'] END AS dialects FROM an)"""


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    """headword (the first letters), form, analysis, n for the words of the corpus."""
    w = F.col("word")
    counts = C.word_counts(tokens(spark, sf)).where(w.rlike("^[a-z]{4,}$"))
    k = (F.ascii(F.substring(w, -1, 1)) + 7 * F.char_length(w) + F.ascii(F.substring(w, 2, 1))) % len(KINDS)
    kinds = F.array(*map(F.lit, KINDS))
    own = F.when(F.char_length(w) % 2 == 0, F.array(F.get(kinds, k), F.get(kinds, (k + 9) % len(KINDS)))).otherwise(F.array(F.get(kinds, k)))
    return counts.select(F.substring(w, 1, 4).alias("headword"), w.alias("form"), F.explode(own).alias("analysis"), F.col("n").cast("int").alias("n"))


@query(f"WITH {_A} SELECT headword, form, list_contains(w, '1st') AS verb, list_has_any(w, ['1st', '2nd', '3rd']) AS verb_form, list_contains(w, 'nom') AND NOT list_has_any(w, ['part', 'pass', 'act']) AS noun, list_has_any(w, ['masc', 'fem', 'neut']) AND NOT list_has_any(w, ['part', 'pass', 'act']) AS noun_form FROM a")
def parts_of_speech(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("analysis")
    return _analyses(spark, sf).select("headword", "form", M.is_verb(a).alias("verb"), M.is_verb(a, False).alias("verb_form"), M.is_noun(a).alias("noun"), M.is_noun(a, False).alias("noun_form"))


@query(f"WITH {_A} SELECT form, (row_number() OVER (PARTITION BY form ORDER BY headword, analysis))::INT AS k, headword AS entry, analysis FROM a")
def morphology_possibilities(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct(F.col("headword").alias("entry"), "analysis")))
    observed = _analyses(spark, sf).groupBy("form").agg(each.alias("l")).select("form", F.map_from_arrays(F.sequence(F.lit(1), F.size("l")), "l").alias("possible"))
    return M.possibilities(observed)


#: Prefixes that words of the corpus get, by their last letter and length; every third word stands alone, every third after a form that was seen.
LATIN_PREFIXES = ["ob", "dis", "ex", "trans", "de_", "ad", "sub", "in", "con", "per", "ab,ex"]
GREEK_PREFIXES = ["ἀπό", "κατά", "περί", "ϲύν", "ἐν", "ἐκ", "ὑπό", "ἀντί"]
#: The corpus' letters as Greek ones, and its vowels with a smooth or a rough breathing where they begin a word.
_LETTERS = ("abcdefgiklmnoprstuwxyzhqj", "αβχδεφγικλμνοπρϲτυωξηζχκι")
_VOWELS, _SMOOTH, _ROUGH = "αειουηω", "ἀἐἰὀὐἠὠ", "ἁἑἱὁὑἡὡ"
_JOINTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LATIN_JOINTS.items()) + "}"
_PREFIXED = f"""{TOKENS}, seen AS (SELECT DISTINCT word FROM tokens WHERE regexp_matches(word, '^[a-z]{{4,}}$')), placed AS (SELECT word, len(word) % 3 AS kind, ascii(right(word, 1)) + len(word) AS k, translate(word, '{_LETTERS[0]}', '{_LETTERS[1]}') AS plain FROM seen),
prefixed AS (SELECT word, kind, plain, [{", ".join(f"'{x}'" for x in LATIN_PREFIXES)}][k % {len(LATIN_PREFIXES)} + 1] AS latin, [{", ".join(f"'{x}'" for x in GREEK_PREFIXES)}][k % {len(GREEK_PREFIXES)} + 1] AS greek,
  translate(left(plain, 1), '{_VOWELS}', CASE WHEN len(word) % 2 = 0 THEN '{_SMOOTH}' ELSE '{_ROUGH}' END) || substr(plain, 2) AS breathed FROM placed)"""


def _latin_sql(prefix: str, stem: str) -> str:
    joint = f"{_JOINTS}[right({prefix}, 1) || left({stem}, 1)]"
    return f"coalesce(left({prefix}, len({prefix}) - 1) || {joint} || substr({stem}, 2), {prefix} || {stem})"


#: The last vowel before a vowel goes (an aspirate follows it before a rough one), a nu becomes what follows; the stem stands without its breathing.
_GREEK_BASE = f"""CASE WHEN contains('{_VOWELS}', left(plain, 1)) AND greek IN ('ἀπό', 'κατά', 'ὑπό', 'ἀντί') THEN
    CASE WHEN len(word) % 2 = 1 THEN replace(replace(translate(left(greek, len(greek) - 1), 'ά', 'α') || '|', 'π|', 'φ'), 'τ|', 'θ') ELSE translate(left(greek, len(greek) - 1), 'ά', 'α') END || plain
  WHEN greek IN ('ϲύν', 'ἐν') AND left(plain, 1) IN ('γ', 'λ', 'μ', 'ϲ') THEN replace(left(greek, len(greek) - 1), 'ύ', 'υ') || left(plain, 1) || plain ELSE translate(greek, 'άίόύ', 'αιου') || plain END"""


def _prefixed(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("word")
    rows = tokens(spark, sf).where(w.rlike("^[a-z]{4,}$")).select("word").distinct()
    k = F.ascii(F.substring(w, -1, 1)) + F.char_length(w)
    pick = lambda some: F.get(F.array(*map(F.lit, some)), k % len(some))
    plain = F.translate(w, *_LETTERS)
    first = F.substring(plain, 1, 1)
    begun = F.when(F.char_length(w) % 2 == 0, F.translate(first, _VOWELS, _SMOOTH)).otherwise(F.translate(first, _VOWELS, _ROUGH))
    return rows.select("word", (F.char_length(w) % 3).alias("kind"), pick(LATIN_PREFIXES).alias("latin"), pick(GREEK_PREFIXES).alias("greek"), F.concat(begun, F.substring(plain, F.lit(2), F.char_length(plain))).alias("breathed"))


@query(f"""WITH {_PREFIXED}, latin AS (SELECT word, CASE WHEN kind = 0 THEN word WHEN latin = 'ab,ex' THEN {_latin_sql("'ab'", '(' + _latin_sql("'ex'", 'word') + ')')} ELSE {_latin_sql("replace(latin, '_', '')", 'word')} END AS base FROM prefixed)
SELECT 'latin' AS language, word, base FROM latin UNION ALL SELECT 'greek', word, CASE WHEN kind = 0 THEN breathed ELSE {_GREEK_BASE} END FROM prefixed""")
def base_forms(spark: SparkSession, sf: str) -> DataFrame:
    """What entries as a parser writes them stand for: a word, a prefix and a stem, or those after a form that was seen."""
    rows, found = _prefixed(spark, sf), None
    for language, stem in (("latin", "word"), ("greek", "breathed")):
        entry = F.concat_ws("-", language, stem)
        entry = F.when(F.col("kind") == 0, F.col(stem)).when(F.col("kind") == 1, entry).otherwise(F.concat(F.lit("seen, "), entry))
        part = rows.select(F.lit(language).alias("language"), "word", M.base_form(entry, language == "greek").alias("base"))
        found = part if found is None else found.unionByName(part)
    return found


@query(f"WITH {_PREFIXED} SELECT word, {_latin_sql('latin', 'word')} AS latin, {_GREEK_BASE} AS greek FROM (SELECT word, kind, plain, greek, replace(replace(latin, '_', ''), 'ab,ex', 'e') AS latin FROM prefixed)")
def compounds(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes and stems put together."""
    one = F.when(F.col("latin") == "ab,ex", F.lit("e")).otherwise(F.col("latin"))
    return _prefixed(spark, sf).select("word", T.joined_prefix(one, F.col("word")).alias("latin"), T.elided_prefix(F.translate("greek", "άίόύ", "αιου"), F.col("breathed")).alias("greek"))


@query(f"WITH {_A}, x AS (SELECT headword, unnest(dialects) AS d FROM a), v AS (SELECT headword, unnest(list_transform(list_filter(w, lambda y: y IN ('act', 'mid', 'pass', 'mp')), lambda y: CASE y WHEN 'mp' THEN 'mid|pass' ELSE y END)) AS v FROM a), g AS (SELECT headword, unnest(list_filter(w, lambda y: y IN ('masc', 'fem', 'neut'))) AS g FROM a) SELECT h.headword, (SELECT string_agg(DISTINCT d, ' ' ORDER BY d) FROM x WHERE x.headword = h.headword) AS dialects, coalesce((SELECT string_agg(DISTINCT s, ' ' ORDER BY s) FROM (SELECT unnest(string_split(v, '|')) AS s FROM v WHERE v.headword = h.headword)), '') AS voices, coalesce((SELECT string_agg(DISTINCT g, ' ' ORDER BY g) FROM g WHERE g.headword = h.headword), '') AS genders FROM (SELECT DISTINCT headword FROM a) h")
def known_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return M.known_attributes(_analyses(spark, sf)).select("headword", *(F.array_join(c, " ").alias(c) for c in ("dialects", "voices", "genders")))


_LIST = "coalesce(string_agg(DISTINCT form || ' (' || n || ')', ' / ' ORDER BY form || ' (' || n || ')') FILTER ({where}), '---') AS {name}"
_GENDERED = ", ".join(_LIST.format(where=f"gender = '{g}'", name=g) for g in M.GENDERS)
_TENSED = ", ".join(_LIST.format(where=f"tense = '{t}'", name=t) for t in M.TENSES)
_PICK = "list_filter(w, lambda y: y IN ({some}))"
_in = lambda some: _PICK.format(some=", ".join(f"'{x}'" for x in some))
_D = f"""{_A}, d1 AS (SELECT *, unnest(dialects) AS dialect, ({_in(M.NUMBERS)})[1] AS number FROM a WHERE len({_in(M.CASES)}) > 0 AND len({_in(M.TENSES)}) = 0),
d2 AS (SELECT *, unnest({_in(M.CASES)}) AS case_ FROM d1), d3 AS (SELECT *, unnest({_in(M.GENDERS)}) AS gender FROM d2)"""
_V = f"""{_A}, v1 AS (SELECT *, unnest(dialects) AS dialect, CASE ({_in(M.VOICES)})[1] WHEN 'mp' THEN ['mid', 'pass'] ELSE {_in(M.VOICES)} END AS vs FROM a WHERE len({_in(M.TENSES)}) > 0),
v2 AS (SELECT *, unnest(vs) AS voice FROM v1),
v3 AS (SELECT *, unnest(CASE WHEN list_contains(w, 'part') THEN flatten(list_transform({_in(M.GENDERS)}, lambda g: list_transform({_in(M.CASES)}, lambda c: g || ' ' || c))) ELSE [coalesce(({_in(M.PERSONS)})[1], '-')] END) AS person,
  ({_in(M.MOODS)})[1] AS mood, coalesce(({_in(M.NUMBERS)})[1], '-') AS number, ({_in(M.TENSES)})[1] AS tense FROM v2)"""


@query(f"WITH {_D} SELECT headword, dialect, number, case_ AS \"case\", {_GENDERED} FROM d3 GROUP BY headword, dialect, number, case_")
def declension_by_dialect(spark: SparkSession, sf: str) -> DataFrame:
    return M.declension_table(_analyses(spark, sf))


@query(f"WITH {_V} SELECT headword, dialect, mood, voice, number, person, {_TENSED} FROM v3 GROUP BY headword, dialect, mood, voice, number, person")
def verb_table(spark: SparkSession, sf: str) -> DataFrame:
    return M.verb_table(_analyses(spark, sf))


@query(f"WITH {_V}, {_D.removeprefix(_A + ', ')} SELECT 'verb' AS what, concat_ws(' ', dialect, mood, voice, number, person) AS row, tense AS column, string_agg(DISTINCT form || ' (' || n || ')', ' / ' ORDER BY form || ' (' || n || ')') AS cell FROM v3 WHERE headword = 'ther' GROUP BY ALL UNION ALL SELECT 'noun', concat_ws(' ', dialect, number, case_), gender, string_agg(DISTINCT form || ' (' || n || ')', ' / ' ORDER BY form || ' (' || n || ')') FROM d3 WHERE headword = 'ther' GROUP BY ALL")
def known_forms(spark: SparkSession, sf: str) -> DataFrame:
    return M.known_forms(_analyses(spark, sf), "ther")


_TRAITS = {"tense": M.TENSES, "mood": M.MOODS, "voice": M.VOICES, "person": M.PERSONS, "number": M.NUMBERS, "gender": M.GENDERS, "case_": M.CASES}
_LISTED = lambda some, words: "list_sort(list_distinct(list_filter(" + words + ", lambda y: y IN (" + ", ".join(f"'{x}'" for x in some) + "))))"
_WANT = "want AS (SELECT part, " + ", ".join(f"{_LISTED(some, 'p')} AS {name}" for name, some in _TRAITS.items()) + " FROM (VALUES " + ", ".join(f"({k}, {v.split()!r})" for k, v in M.LATIN_PARTS.items()) + ") v(part, p))"
_NEAR = lambda *names: " AND ".join(f"v.{n} = t.{n}" for n in names)


@query(f"""WITH {_A}, {_WANT}, v AS (SELECT headword, form, {", ".join(f"{_LISTED(some, 'w')} AS {name}" for name, some in _TRAITS.items())} FROM a WHERE len({_LISTED(M.TENSES, 'w')}) > 0),
met AS (SELECT headword, part, form, CASE WHEN {_NEAR(*_TRAITS)} THEN 0 WHEN {_NEAR('tense', 'mood', 'voice', 'person')} THEN 1 WHEN {_NEAR('tense', 'mood', 'voice', 'number')} THEN 2 WHEN {_NEAR('tense', 'mood', 'voice')} THEN 3 WHEN {_NEAR('tense', 'mood', 'person', 'number')} THEN 4 WHEN {_NEAR('tense', 'mood')} THEN 5 END AS rung FROM v, want t),
first_ AS (SELECT headword, part, min((rung, form)) AS best FROM met WHERE rung IS NOT NULL GROUP BY ALL),
told AS (SELECT DISTINCT m.headword, m.part, m.form, m.rung = 0 AS exact FROM met m JOIN first_ f USING (headword, part) WHERE m.rung = 0 OR (m.rung, m.form) = f.best)
SELECT h.headword, h.part, form, coalesce(exact, false) AS exact FROM (SELECT DISTINCT headword, part FROM v, want) h LEFT JOIN told USING (headword, part)""")
def principal_parts(spark: SparkSession, sf: str) -> DataFrame:
    return M.principal_parts(_analyses(spark, sf), greek=False)


#: Analyses for words of the corpus, by their ending, so that both engines agree.
_KINDS = f"{TOKENS}, vocabulary AS (SELECT word, count(*)::BIGINT AS n FROM tokens GROUP BY word), kinds AS (SELECT word AS form, CASE WHEN word LIKE '%ing' THEN 'pres part act' WHEN word LIKE '%ed' THEN 'perf ind act 3rd sg' WHEN word LIKE '%s' THEN 'neut nom pl' END AS analysis FROM vocabulary)"


@query(f"WITH {_KINDS} SELECT word, n, true AS verb FROM vocabulary WHERE word LIKE '%ed' UNION ALL SELECT word, n, false FROM vocabulary WHERE word LIKE '%s'")
def vocabulary_by_part_of_speech(spark: SparkSession, sf: str) -> DataFrame:
    counts = C.word_counts(tokens(spark, sf))
    w = F.col("word")
    analyses = counts.select(w.alias("form"), F.when(F.endswith(w, F.lit("ing")), "pres part act").when(F.endswith(w, F.lit("ed")), "perf ind act 3rd sg").when(F.endswith(w, F.lit("s")), "neut nom pl").alias("analysis")).where("analysis is not null")
    return M.of_kind(counts, analyses, True).withColumn("verb", F.lit(True)).unionByName(M.of_kind(counts, analyses, False).withColumn("verb", F.lit(False)))


#: A dictionary out of the corpus: the first word of every work, two of three with a superscript, some with a capital; and the words that its lines begin with, to ask for.
_BEGUN = f"""{TOKENS}, begins AS (SELECT work_id, idx, word FROM (SELECT work_id, idx, {index_words('line')}[1] AS word FROM lines) WHERE word <> ''),
dictionary AS (SELECT work_id AS id, CASE WHEN work_id % 5 = 0 THEN upper(left(word, 1)) || substr(word, 2) ELSE word END || ['', '¹', '²'][work_id % 3 + 1] AS entry FROM begins WHERE idx = 1)"""


def _dictionary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """id, entry; and work_id, idx, word of the words that lines begin with."""
    begins = corpus.lines(corpus.works(spark, sf)).select("work_id", "idx", F.get(T.index_tokens(F.col("line")), F.lit(0)).alias("word")).where("word is not null")
    w = F.col("word")
    big = F.when(F.col("work_id") % 5 == 0, F.concat(T.capitals(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))).otherwise(w)
    above = F.get(F.array(F.lit(""), F.lit("¹"), F.lit("²")), (F.col("work_id") % 3).cast("int"))
    return begins.where("idx = 1").select(F.col("work_id").alias("id"), F.concat(big, above).alias("entry")), begins


@query(f"""WITH {_BEGUN}, {FORMS}, asked AS (SELECT DISTINCT ' ' || upper(word) AS term, translate(word, 'vj', 'ui') AS probe FROM begins WHERE idx = 2), bare AS (SELECT id, entry, lower(entry) AS low, rtrim(lower(entry), '¹²') AS bare FROM dictionary),
found AS (SELECT term, 1 AS rung, id, entry FROM asked JOIN bare ON probe = low UNION ALL SELECT term, 2, id, entry FROM asked JOIN bare ON probe = bare UNION ALL SELECT term, 3, id, entry FROM asked JOIN forms ON probe = form JOIN bare ON headword = bare)
SELECT DISTINCT term, rung, id, entry FROM (SELECT *, min(rung) OVER (PARTITION BY term) AS least FROM found) WHERE rung = least""")
def dictionary_look_up(spark: SparkSession, sf: str) -> DataFrame:
    entries, begins = _dictionary(spark, sf)
    asked = begins.where("idx = 2").select(F.concat(F.lit(" "), T.capitals(F.col("word"))).alias("term")).distinct()
    return L.look_up(asked, entries, C.suffix_forms(tokens(spark, sf).select("word").distinct()))


@query(f"WITH {_A}, asked AS (SELECT DISTINCT upper(word) AS term, word AS form FROM tokens WHERE idx = 1 AND work_id % 10 = 0), k AS (SELECT headword, string_agg(DISTINCT form, ' ' ORDER BY form) AS forms FROM a GROUP BY headword) SELECT t.term, k.headword, k.forms FROM (SELECT DISTINCT t.term, a.headword FROM asked t JOIN a ON a.form = translate(t.form, 'vj', 'ui')) t JOIN k USING (headword)")
def find_by_inflected_form(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpus.lines(corpus.works(spark, sf)).where("idx = 1 and work_id % 10 = 0")
    asked = lines.select(F.explode(T.index_tokens(F.col("line"))).alias("word")).select(T.capitals(F.col("word")).alias("term")).distinct()
    return L.by_inflected_form(asked, _analyses(spark, sf)).select("term", "headword", F.array_join("forms", " ").alias("forms"))


@query(f"WITH {_BEGUN}, x AS (SELECT work_id AS xref, word || ['', '¹', '²'][(work_id + 1) % 3 + 1] AS entry FROM begins WHERE idx = 1), d AS (SELECT * FROM dictionary WHERE id % 2 = 0), one AS (SELECT xref, 1 AS rung, id, d.entry FROM x JOIN d ON x.entry = d.entry UNION ALL SELECT xref, 2, id, d.entry FROM x JOIN d ON rtrim(x.entry, '¹²') = rtrim(d.entry, '¹²')) SELECT xref, arg_min(id, (rung, id))::BIGINT AS id, arg_min(entry, (rung, id)) AS entry FROM one GROUP BY xref")
def entry_by_cross_reference(spark: SparkSession, sf: str) -> DataFrame:
    entries, begins = _dictionary(spark, sf)
    above = F.get(F.array(F.lit(""), F.lit("¹"), F.lit("²")), ((F.col("work_id") + 1) % 3).cast("int"))
    return L.by_cross_reference(begins.where("idx = 1").select(F.col("work_id").alias("xref"), F.concat("word", above).alias("entry")), entries.where("id % 2 = 0"))


@query("WITH d AS (SELECT 'part' AS dictionary, p_partkey AS entry, p_type AS translations FROM part UNION ALL SELECT 'name', p_partkey, p_name FROM part), c AS (SELECT l_partkey AS entry, count(*)::BIGINT AS total FROM lineitem GROUP BY 1) SELECT dictionary, entry, translations, coalesce(total, 0)::BIGINT AS total, row_number() OVER (ORDER BY coalesce(total, 0) DESC, entry, dictionary) AS place FROM d LEFT JOIN c USING (entry) WHERE regexp_matches(translations, '(small|ECONOMY)')")
def reverse_search_of_two(spark: SparkSession, sf: str) -> DataFrame:
    part = corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("entry"), "p_type", "p_name")
    both = {"part": part.select("entry", F.col("p_type").alias("translations")), "name": part.select("entry", F.col("p_name").alias("translations"))}
    counts = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entry")).agg(F.count("*").alias("total"))
    return L.reverse_search(both, counts, "(small|ECONOMY)")

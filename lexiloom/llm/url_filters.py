"""Operator 10: URL filters by rules and a weighted vocabulary.

A rule allows or blocks a host with all its subdomains below a path; of the rules that fit a URL the longest decides. Where none
fits, an Aho-Corasick automaton over the lower-cased URL counts vocabulary terms that stand alone (no ASCII letter or digit
directly before or after): one strict term rejects, and so do at least SOFT_HITS distinct soft terms whose weights reach SOFT_WEIGHT.

The vocabulary is a table of term, kind (strict or soft) and weight: url_vocabulary.tsv beside this module, or any other with these
columns. Its terms travel with the tasks, so it is bounded by MOST_TERMS.

Defined results: a null URL, or one without `://`, has an empty host and path and no rule; the vocabulary still reads whatever
text there is (null: nothing), so a null or empty URL is allowed. Rows are judged one by one, so repeats and ties change nothing;
two rules equally long go by the rule's text; of equal terms the last counts. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: (action, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Distinct soft terms that reject a URL, at least, and the sum of their weights.
SOFT_HITS = 2
SOFT_WEIGHT = 3.0
MOST_TERMS = 1_000_000


class Term(NamedTuple):
    term: str
    kind: str  # strict or soft
    weight: float


@cache
def packaged_vocabulary() -> tuple[Term, ...]:
    lines = Path(__file__).with_name("url_vocabulary.tsv").read_text().splitlines()[1:]
    return tuple(Term(t, kind, float(w)) for t, kind, w in (line.split("\t") for line in lines))


def vocabulary(rows: DataFrame) -> tuple[Term, ...]:
    """The vocabulary of a table: term, kind, weight."""
    found = rows.where("term <> ''").select("term", "kind", F.col("weight").cast("double")).orderBy("term", "kind").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(Term(*r) for r in found)


def host_and_path(url):
    """Columns: host (ASCII lower case) and path of a URL column; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host, path, rules=RULES):
    """Columns: text and action of the longest rule that fits; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, where, below in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(below))
        text = F.when(fits, where + below).otherwise(text)
        action = F.when(fits, act).otherwise(action)
    return text, action


def _automaton(terms: Iterable[Term]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t.term.lower(), t._replace(term=t.term.lower()))
    found.make_automaton()
    return found


def vocabulary_hits(url: str | None, automaton) -> tuple[int, int, float]:
    """Strict terms found, distinct soft terms found, and the sum of the soft terms' weights."""
    text = (url or "").lower()
    strict, soft = 0, {}
    plain = lambda c: c.isascii() and c.isalnum()
    for last, t in automaton.iter(text) if len(automaton) else ():
        first = last + 1 - len(t.term)
        if (first and plain(text[first - 1])) or (last + 1 < len(text) and plain(text[last + 1])):
            continue
        if t.kind == "strict":
            strict += 1
        else:
            soft[t.term] = t.weight
    return strict, len(soft), float(sum(soft.values()))


def url_verdicts(pages: DataFrame, rules=RULES, terms: Iterable[Term] | None = None, soft_hits: int = SOFT_HITS, soft_weight: float = SOFT_WEIGHT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_terms, soft_weight."""
    terms = packaged_vocabulary() if terms is None else tuple(terms)
    ship(pages.sparkSession)

    @F.pandas_udf("strict_hits int, soft_terms int, soft_weight double")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(terms)
        for urls in parts:
            yield pd.DataFrame([vocabulary_hits(u, automaton) for u in urls], columns=["strict_hits", "soft_terms", "soft_weight"])

    host, path = host_and_path(F.col("url_"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url_")).select(id_col, "url_", host.alias("host"), path.alias("path"))
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), action.alias("action_"), hits("url_").alias("hits_"))
    by_terms = F.when((F.col("hits_.strict_hits") > 0) | ((F.col("hits_.soft_terms") >= soft_hits) & (F.col("hits_.soft_weight") >= soft_weight)), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", "rule", F.coalesce("action_", by_terms).alias("verdict"), F.col("hits_.strict_hits"), F.col("hits_.soft_terms"), F.col("hits_.soft_weight"))


def oracle(rules=RULES, terms: Iterable[Term] | None = None, soft_hits: int = SOFT_HITS, soft_weight: float = SOFT_WEIGHT) -> str:
    """The same verdicts as DuckDB SQL: runs of letters and digits are what a term that stands alone can be (terms are such runs)."""
    terms = packaged_vocabulary() if terms is None else tuple(terms)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{pick(r)}'" for r in ordered) + " END"
    table = ", ".join(f"('{t.term.lower()}', '{t.kind}', {t.weight})" for t in terms)
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), vocabulary(term, kind, weight) AS (VALUES {table}),
met AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9]+')) AS term FROM pages),
counted AS (
  SELECT page_id, term, kind, any_value(weight) AS weight, count(*) AS n FROM met JOIN vocabulary USING (term) GROUP BY page_id, term, kind
), summed AS (
  SELECT page_id, CAST(sum(CASE WHEN kind = 'strict' THEN n ELSE 0 END) AS INT) AS strict_hits,
         CAST(count(*) FILTER (kind <> 'strict') AS INT) AS soft_terms, CAST(coalesce(sum(weight) FILTER (kind <> 'strict'), 0) AS DOUBLE) AS soft_weight FROM counted GROUP BY page_id
), judged AS (
  SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS action,
         coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_terms, 0) AS soft_terms, coalesce(soft_weight, 0) AS soft_weight FROM cut LEFT JOIN summed USING (page_id)
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN strict_hits > 0 OR (soft_terms >= {soft_hits} AND soft_weight >= {soft_weight}) THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_terms, soft_weight
FROM judged"""

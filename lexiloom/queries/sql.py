"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..functions.text import FOLD_FROM, FOLD_TO, INDEX_MARKS, accent_pairs

LINES = """lines AS (
  SELECT lang AS corpus, source AS author, doc_id AS work_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS idx
  FROM documents
)"""
CATALOG = """marks AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
catalog AS (
  SELECT lang AS corpus, source AS author, d.doc_id AS work_id,
         'doc ' || d.doc_id || CASE WHEN quality = 0 THEN ' [Sp.]' ELSE '' END AS title,
         lang || ',' || CASE d.doc_id % 3 WHEN 0 THEN 'epic' WHEN 1 THEN 'hist' ELSE 'phil' END AS genre,
         CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 17 = 0 THEN 2000 WHEN d.doc_id % 19 = 0 THEN 2500 ELSE (d.doc_id * 37) % 1300 - 700 END::INT AS date,
         (d.doc_id % 7)::INT AS place_key, n_chars AS size
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
),
authors AS (
  SELECT DISTINCT author, CASE WHEN regexp_replace(author, '[^0-9]', '', 'g')::INT % 3 = 0 THEN NULL ELSE regexp_replace(author, '[^0-9]', '', 'g')::INT * 50 - 400 END::INT AS author_date,
         'place ' || (regexp_replace(author, '[^0-9]', '', 'g')::INT % 4) AS location
  FROM catalog
),
dated AS (SELECT c.*, author_date, location, coalesce(date, author_date) AS eff FROM catalog c LEFT JOIN authors a USING (author))"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bare(expression: str) -> str:
    """Text as an index lists it: lower case, punctuation, symbols, digits and a few marks off, graves as acutes, v as u."""
    graves, acutes = accent_pairs()
    return f"translate(regexp_replace(lower({expression}), '[\\p{{P}}\\p{{S}}0-9{INDEX_MARKS}]', '', 'g'), {quoted(graves + 'v')}, {quoted(acutes + 'u')})"


def index_words(expression: str) -> str:
    return f"list_filter(string_split(replace({bare(expression)}, chr(160), ' '), ' '), lambda w: w <> '')"


BARE = bare("line")
TOKENS = f"""{LINES}, tokens AS (
  SELECT corpus, author, work_id, idx, unnest({index_words('line')}) AS word FROM lines
)"""


def fold(expression: str) -> str:
    return f"translate({expression}, {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"

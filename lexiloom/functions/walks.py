"""What must be read from left to right: tags and brackets that stay open over the lines of a work, and marks put beside tags. Each is one pass over a row's own
text, in Python, a batch of rows at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .text import BRACKETS, strip_markup

_TAG = re.compile(r"<[^>]*>")


def spans_over_lines(lines: list[str | None], tag: str) -> list[dict]:
    """Lines made whole by themselves: what earlier lines left open is opened again with its class, and what stays open at a line's end is
    closed. before, after: the classes open there, the outermost first. A closing tag that nothing opened stays as it is and closes nothing."""
    found = re.compile(rf'<{tag}\b([^>]*)>|</{tag}>')
    named = re.compile(r'\bclass="([^"]*)"')
    again = lambda name: f'<{tag} class="{name}">' if name else f"<{tag}>"
    stack, out = [], []
    for line in lines:
        before = list(stack)
        for m in found.finditer(line or ""):
            if m[1] is None:
                del stack[-1:]
            elif not m[1].endswith("/"):
                name = named.search(m[1])
                stack.append(name[1] if name else "")
        whole = None if line is None else "".join(map(again, before)) + line + f"</{tag}>" * len(stack)
        out.append({"line": whole, "before": before, "after": list(stack)})
    return out


def insertions_over_lines(lines: list[str | None], kinds: tuple[str, ...] = tuple(BRACKETS)) -> list[dict]:
    """Lines with a span around what stands in each family of brackets, which may stay open over lines. A closing bracket that comes first in its line closes what
    was open since the line's beginning; others that nothing opened, and opening ones within their own family, are text. Where families
    cross, the inner spans end with the outer one and begin again behind it, so that spans nest. Brackets within tags don't count. open: the families open
    at the line's end, sorted."""
    opens, closes = {BRACKETS[k][0]: k for k in kinds}, {BRACKETS[k][1]: k for k in kinds}
    find = re.compile("<[^>]*>|[" + re.escape("".join([*opens, *closes])) + "]")
    span = lambda names: "".join(f'<span class="{k}">' for k in names)
    stack, out = [], []
    for line in lines:
        if line is None:
            out.append({"line": None, "open": sorted(stack)})
            continue
        marks, first = [m for m in find.finditer(line) if len(m[0]) == 1], {}
        for m in marks:
            first.setdefault(opens.get(m[0]) or closes[m[0]], m[0])
        stack += [k for k in kinds if first.get(k) in closes and k not in stack]
        parts, at = [span(stack)], 0
        for m in marks:
            kind = opens.get(m[0])
            if kind and kind not in stack:
                parts += [line[at : m.end()], span([kind])]
                stack.append(kind)
                at = m.end()
            elif not kind and closes[m[0]] in stack:
                place = stack.index(closes[m[0]])
                inner = stack[place + 1 :]
                parts += [line[at : m.start()], "</span>" * (len(inner) + 1), span(inner), m[0]]
                del stack[place]
                at = m.end()
        out.append({"line": "".join(parts) + line[at:] + "</span>" * len(stack), "open": sorted(stack)})
    return out


def marks_beside_tags(text: str | None, marked: str | None) -> str | None:
    """text, which holds tags, with <b> and </b> where `marked` (the same text without its tags) has the characters 1 and 2. A mark that goes over a tag ends before
    it and begins again behind it, so that tags nest."""
    if text is None or marked is None or "\x01" not in marked:
        return text
    out, k, at, inside = [], 0, 0, False
    pieces = [(m.start(), m.end()) for m in _TAG.finditer(text)] + [(len(text), len(text))]
    for lo, hi in pieces:
        left = lo - at
        while left or (k < len(marked) and marked[k] == "\x02"):
            c = marked[k]
            k += 1
            if c in "\x01\x02":
                inside = c == "\x01"
                out.append("<b>" if inside else "</b>")
            else:
                out.append(c)
                left -= 1
        if inside and hi > lo:
            out.append("</b>" + text[lo:hi] + "<b>")
        else:
            out.append(text[lo:hi])
        at = hi
    return "".join(out).replace("<b></b>", "")


def carried_spans(spark: SparkSession, lines: Column, tag: str = "span") -> Column:
    """array<struct<line, before, after>> of an array of lines (see spans_over_lines)."""
    ship(spark)

    @F.pandas_udf("array<struct<line:string,before:array<string>,after:array<string>>>")
    def walk(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: spans_over_lines(list(x), tag), na_action="ignore")

    return walk(lines)


def editorial_insertions(spark: SparkSession, lines: Column, kinds: tuple[str, ...] = tuple(BRACKETS)) -> Column:
    """array<struct<line, open>> of an array of lines (see insertions_over_lines)."""
    ship(spark)

    @F.pandas_udf("array<struct<line:string,open:array<string>>>")
    def walk(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: insertions_over_lines(list(x), kinds), na_action="ignore")

    return walk(lines)


def highlight(spark: SparkSession, column: Column, pattern: str) -> Column:
    """Matches of a pattern in the text without its tags set in <b>; no tag is broken, and a match may go over tags."""
    ship(spark)

    @F.pandas_udf("string")
    def merge(text: pd.Series, marked: pd.Series) -> pd.Series:
        return pd.Series([marks_beside_tags(t, m) for t, m in zip(text, marked)], dtype=object)

    plain = F.regexp_replace(column, f"({pattern})", "<b>$1</b>")
    marked = F.regexp_replace(strip_markup(column), f"({pattern})", "\x01$1\x02")
    return F.when(column.contains("<"), merge(column, marked)).otherwise(plain)

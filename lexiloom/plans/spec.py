"""A search as one object: terms, scope, nearness, limits, order. `plan` turns it into a DataFrame; nothing runs until it is asked for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scope as P
from ..operators import search as S
from ..sources import corpus, interim
from .restrict import restricted

CORPORA = ("de", "en", "es", "fr")
SORT_KEYS = ("name", "date", "genre", "location", "work")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


@dataclass(frozen=True)
class SearchSpec:
    """term and other are words as typed (blanks at their ends anchor them); lemma and other_lemma are headwords."""

    term: str = ""
    other: str = ""
    lemma: str = ""
    other_lemma: str = ""
    near: bool = True
    unit: str = "lines"
    distance: int = 1
    scope: P.Scope = field(default_factory=P.Scope)
    cap: int = 200
    one_hit: bool = False
    context: int = 0
    sort: str = "name"

    def checked(self) -> SearchSpec:
        """Values in their bounds: distance 1 to 15, context 0 to 20, a known unit and sort key, known corpora."""
        scope = replace(self.scope, corpora=tuple(c for c in self.scope.corpora if c in CORPORA))
        if scope.earliest is not None and scope.latest is not None and scope.earliest > scope.latest:
            scope = replace(scope, latest=scope.earliest)
        return replace(self, distance=clamp(self.distance, 1, 15), context=clamp(self.context, 0, 20), cap=max(self.cap, 1), unit=self.unit if self.unit in ("lines", "words") else "lines", sort=self.sort if self.sort in SORT_KEYS else "name", scope=scope)

    @property
    def kind(self) -> str:
        """simple, lemma, proximity, phrase or phrase and proximity: by the terms given."""
        words = len(self.term.split())
        second = bool(self.other.strip() or self.other_lemma)
        if words > 1:
            return "phrase and proximity" if second else "phrase"
        if second:
            return "proximity"
        return "lemma" if self.lemma else "simple"


def corpora_mask(corpora: tuple[str, ...]) -> int:
    """The corpora as bits, in the order of CORPORA."""
    return sum(1 << k for k, c in enumerate(CORPORA) if c in corpora)


def mask_of(corpora: Column) -> Column:
    """corpora_mask of a column that lists corpora."""
    bits = [F.when(F.array_contains(corpora, c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(CORPORA)]
    return reduce(lambda a, b: a + b, bits)


def rationalised(scope: P.Scope, author_of: dict[int, str] | None = None) -> P.Scope:
    """A scope without what it says twice: choices that are excluded again, and, where the authors of works are given, chosen works of
    chosen authors and excluded works of excluded ones."""
    of = (author_of or {}).get
    without_works = [w for w in scope.without_works if of(w) not in scope.without_authors]
    authors = set(scope.authors) - set(scope.without_authors)
    works = [w for w in scope.works if w not in scope.without_works and of(w) not in authors | set(scope.without_authors)]
    return replace(scope, authors=tuple(sorted(authors)), works=tuple(sorted(set(works))), without_works=tuple(sorted(set(without_works))))


def _line_test(term: str, headword: str, forms: DataFrame | None):
    """What lines are tested for: a pattern on the form of the line that the term asks for, or the forms of a headword."""
    if headword:
        return S.holding(S.forms_of(forms, headword))
    pattern, form = T.term_pattern(T.clean_query(term)), T.line_form(term)
    return lambda line: form(line).rlike(pattern)


def _word_test(term: str, headword: str, forms: DataFrame | None):
    return S.one_of(S.forms_of(forms, headword)) if headword else term.strip().lower()


def hits(spec: SearchSpec, works: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """All hits of a checked spec in works already scoped. Words and lines as units hold for terms, headwords and phrases alike."""
    spark = works.sparkSession
    patterns = [T.term_pattern(T.clean_query(t)) for t, lemma in ((spec.term, spec.lemma), (spec.other, spec.other_lemma)) if t.strip() and not lemma]
    if not all(S.valid_pattern(spark, p) for p in patterns):
        return S.simple(works.limit(0), "x")
    phrase = T.term_pattern(T.clean_query(spec.term, regex=False)).strip()
    if spec.kind == "phrase":
        return S.phrase(works, phrase, T.line_form(spec.term))
    if spec.kind in ("proximity", "phrase and proximity") and spec.unit == "words":
        first = spec.term.lower().split() if spec.kind == "phrase and proximity" else _word_test(spec.term, spec.lemma, forms)
        return S.near_words(works, first, _word_test(spec.other, spec.other_lemma, forms), spec.distance, spec.near)
    if spec.kind == "phrase and proximity":
        return S.phrase_near(works, phrase, _line_test(spec.other, spec.other_lemma, forms), spec.distance, spec.near, T.line_form(spec.term))
    first = _line_test(spec.term, spec.lemma, forms)
    if spec.kind == "proximity":
        return S.near_lines(works, first, _line_test(spec.other, spec.other_lemma, forms), spec.distance, spec.near)
    return S.simple(works, first)


def plan(spec: SearchSpec, works: DataFrame, catalog: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """number, author, work_id, title, idx, line, and context lines where asked (hit_idx, idx, line)."""
    spec = spec.checked()
    authors = corpus.authors(catalog)
    named = catalog.where(F.col("work_id").isin(*spec.scope.works, *spec.scope.without_works)).select("work_id", "author").collect()  # as many as the spec names
    chosen = interim.written(P.compile_scope(catalog, authors, rationalised(spec.scope, {r.work_id: r.author for r in named})), "scope")
    found = hits(spec, restricted(works, catalog, chosen), forms)
    if spec.one_hit:
        found = S.one_per_author(found)
    rows = found.join(chosen.select("work_id", "title", "date", "author_date", "genre", "location"), "work_id")
    year = F.coalesce(F.when(F.col("date") > 2000, F.col("author_date")).otherwise(F.col("date")), F.lit(9999))
    key = {"name": F.col("author"), "date": year, "genre": F.col("genre"), "location": F.col("location"), "work": F.col("work_id")}[spec.sort]
    rows = rows.withColumn("key", key)
    top = S.capped(rows, spec.cap, ["key", "author", "work_id", "idx"]).select("number", "author", "work_id", "title", "idx", "line")
    if not spec.context:
        return top
    around = S.with_context(top, works, spec.context)
    return top.select("number", "author", "work_id", "title", F.col("idx").alias("hit_idx")).join(around, ["work_id", "hit_idx"])

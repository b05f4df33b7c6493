"""A corpus of nine lines with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import browse as B
from lexiloom.operators import concordance as C
from lexiloom.operators import search as S
from lexiloom.operators import stats as A
from lexiloom.operators import vectors as V
from lexiloom.sources import corpus

WORKS = [
    ("la", "a1", 1, ["arma uirumque cano", "troiae qui primus ab", "oris italiam fato", "profugus arma tulit"]),
    ("la", "a1", 2, ["cano carmen", "uirum arma"]),
    ("la", "a2", 3, ["nihil se", "in eo potestatis", "arma"]),
]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(WORKS, "corpus string, author string, work_id long, lines array<string>")


def places(rows):
    return sorted((r.work_id, r.idx) for r in rows.collect())


ARMA, CANO = T.term_pattern(" arma "), T.term_pattern(" cano ")


def test_simple(works):
    assert places(S.simple(works, ARMA)) == [(1, 1), (1, 4), (2, 2), (3, 3)]


def test_first_per_author(works):
    assert places(S.first_per_author(S.simple(works, ARMA), 2)) == [(1, 1), (1, 4), (3, 3)]


def test_one_per_author(works):
    assert places(S.one_per_author(S.simple(works, ARMA))) == [(1, 1), (3, 3)]


def test_near_and_not_near_part_the_hits(works):
    near, far = places(S.near_lines(works, ARMA, CANO, 1)), places(S.near_lines(works, ARMA, CANO, 1, near=False))
    assert near == [(1, 1), (2, 2)] and far == [(1, 4), (3, 3)]


@pytest.mark.parametrize("words,found", [("qui primus", [(1, 2)]), ("ab oris", [(1, 2)]), ("se in", [(3, 1)]), ("tulit cano", []), ("primus ab oris", [(1, 2)])])
def test_phrase(works, words, found):
    assert places(S.phrase(works, words)) == found


def test_near_words_stay_in_the_work(works):
    assert places(S.near_words(works, "cano", "arma", 2)) == [(1, 1)]
    assert places(S.near_words(works, "cano", "arma", 2, near=False)) == [(2, 1)]


def test_phrase_near(works):
    assert places(S.phrase_near(works, "ab oris", ARMA, 1)) == [(1, 2)]
    assert places(S.phrase_near(works, "ab oris", T.term_pattern(" tulit "), 1)) == []


def test_context_ends_with_the_work(works):
    hits = S.simple(works, T.term_pattern(" tulit "))
    assert [r.idx for r in S.with_context(hits, works, 4).orderBy("idx").collect()] == [2, 3, 4]


def test_odd_context_leans_back(spark):
    one = spark.createDataFrame([("x", "a", 1, [str(i) for i in range(1, 21)])], "corpus string, author string, work_id long, lines array<string>")
    hits = corpus.lines(one).where("idx = 10")
    assert [r.idx for r in S.with_context(hits, one, 3).orderBy("idx").collect()] == [8, 9, 10, 11]
    assert [r.idx for r in S.with_context(hits, one, 4).orderBy("idx").collect()] == [8, 9, 10, 11, 12]


def test_concordance(works):
    tokens = C.words(corpus.lines(works))
    rows = sorted(C.by_word(tokens).collect(), key=lambda r: r.work_id)
    got = {w: (rows_[0].total, "; ".join(f"{r.work_id}: {r.loci}" for r in rows_)) for w in {r.word for r in rows} if (rows_ := [r for r in rows if r.word == w]) and sum(r.n for r in rows_) == rows_[0].total}
    assert got["arma"] == (4, "1: 1, 4; 2: 2; 3: 3") and got["cano"] == (2, "1: 1; 2: 1")
    assert sum(n for n, _ in got.values()) == 23


def test_forms_and_headwords(spark):
    forms = C.suffix_forms(spark.createDataFrame([("bases",), ("cat",), ("sing",)], "word string"))
    assert sorted((r.form, r.headword) for r in forms.collect()) == [("bases", "bas"), ("bases", "base"), ("bases", "bases"), ("cat", "cat"), ("sing", "sing")]


def test_weights_and_distribution(spark):
    total = spark.createDataFrame([(100, 10)], "gr int, lt int")
    w = A.weights(total, ["gr", "lt"])
    assert tuple(w.first()) == (1.0, 10.0)
    counts = spark.createDataFrame([("x", 5, 1)], "word string, gr int, lt int")
    assert tuple(A.weighted(counts, w, ["gr", "lt"]).first()) == ("x", 50.0, 100.0)


def test_bundles_drop_the_rest(spark):
    one = spark.createDataFrame([("x", "a", 1, ["one two. three. four.", "five. six"])], "corpus string, author string, work_id long, lines array<string>")
    got = [" ".join(r.words) for r in V.bundled(one, 2).orderBy("bundle").collect()]
    assert got == ["one two three", "four fiue"]


def test_locus(spark):
    row = spark.createDataFrame([("-1", "2", "1", "4")], "a string, b string, c string, d string")
    assert row.select(B.locus([F.col(c) for c in "abcd"])).first()[0] == "2.1.4"


def test_open_brackets_carry_on(spark):
    one = spark.createDataFrame([("x", "a", 1, ["a (b", "c", "d) e", "(f) g"])], "corpus string, author string, work_id long, lines array<string>")
    assert [r.open for r in B.bracket_state(one).orderBy("idx").collect()] == [1, 1, 0, 0]


def test_empty_works(spark):
    none = spark.createDataFrame([], "corpus string, author string, work_id long, lines array<string>")
    assert places(S.simple(none, ARMA)) == places(S.near_lines(none, ARMA, CANO, 1)) == places(S.near_words(none, "a", "b", 1)) == []


def test_null_lines(spark):
    rows = spark.createDataFrame([("x", None, 1, None), ("x", "a", 2, [None, "arma"])], "corpus string, author string, work_id long, lines array<string>")
    assert places(S.simple(rows, ARMA)) == [(2, 2)] and places(S.phrase(rows, "arma uirum")) == []

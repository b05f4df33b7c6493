import pytest
from pyspark.sql import functions as F

from lexiloom.operators import lexicon as L
from lexiloom.operators import scope as P
from lexiloom.operators import search as S
from lexiloom.plans.spec import SearchSpec, corpora_mask, rationalised
from lexiloom.sources import models
from lexiloom.streaming import search as ST


@pytest.fixture(scope="module")
def catalog(spark):
    works = [("la", "a", 1, "one", "epic", -350), ("la", "a", 2, "two [Sp.]", "epic,hist", None), ("la", "b", 3, "three", "phil", None), ("la", "a", 4, "four", "epic", 2000)]
    return spark.createDataFrame(works, "corpus string, author string, work_id long, title string, genre string, date int"), spark.createDataFrame([("a", -350, "x"), ("b", None, "y")], "author string, author_date int, location string")


def ids(catalog, **what):
    return sorted(r.work_id for r in P.compile_scope(*catalog, P.Scope(**what)).collect())


def test_dates(catalog):
    assert ids(catalog, earliest=-400, latest=-300) == [1, 2, 3, 4]
    assert ids(catalog, earliest=-400, latest=-300, various=False) == [1, 2, 3]
    assert ids(catalog, earliest=100, latest=200, various=False) == [3]


def test_spurious_stay_only_when_named(catalog):
    assert ids(catalog, spurious=False) == [1, 3, 4] and ids(catalog, works=(2,), spurious=False) == [2]


def test_genres(catalog):
    assert ids(catalog, genres=("hist",), exact_genres=True) == [2] and ids(catalog, genres=("i",)) == [1, 2, 3, 4]
    assert ids(catalog, without_authors=("a",)) == [3]


def test_whole_author(catalog):
    works = catalog[0]
    assert sorted(r.scope_id for r in P.whole_authors(works, works.where("work_id in (1, 3)")).collect()) == ["aw1", "b"]


def test_fingerprint_ignores_order_and_repeats(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "i long") for xs in ([1, 2, 3], [3, 1, 2, 2]))
    assert P.fingerprint(a, "i").first() == P.fingerprint(b, "i").first()


@pytest.mark.parametrize("what,kind", [({"term": "arma"}, "simple"), ({"term": "arma uirum"}, "phrase"), ({"lemma": "cano"}, "lemma"), ({"term": "arma", "other": "cano"}, "proximity"), ({"term": "arma uirum", "other": "cano"}, "phrase and proximity")])
def test_kind(what, kind):
    assert SearchSpec(**what).kind == kind


def test_bounds():
    got = SearchSpec(term="x", distance=99, context=50, sort="?", unit="?", cap=0, scope=P.Scope(corpora=("en", "zz"))).checked()
    assert (got.distance, got.context, got.sort, got.unit, got.cap, got.scope.corpora) == (15, 20, "name", "lines", 1, ("en",))
    assert corpora_mask(("de", "es")) == 5
    assert rationalised(P.Scope(authors=("a", "b"), without_authors=("b",))).authors == ("a",)
    scope = rationalised(P.Scope(authors=("a",), works=(1, 2, 3, 4), without_works=(4, 5), without_authors=("c",)), {1: "a", 2: "b", 3: "c", 4: "b", 5: "c"})
    assert (scope.works, scope.without_works) == ((2,), (4,))


def test_invalid_pattern_is_told(spark):
    assert S.valid_pattern(spark, "a+") and not S.valid_pattern(spark, "(a")


def test_ladder_takes_the_first_rung(spark):
    asked = spark.createDataFrame([("cats",), ("dog",), ("zz",)], "term string")
    entries = spark.createDataFrame([("cat", 1), ("dog", 2), ("do", 3)], "entry string, n int")
    t = F.col("term")
    got = L.ladder(asked, entries, [t, F.regexp_replace(t, "s$", ""), F.regexp_replace(t, "g$", "")])
    assert sorted((r.term, r.rung, r.entry) for r in got.collect()) == [("cats", 2, "cat"), ("dog", 1, "dog")]


def test_neighbours_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7, f"e{i}") for i in range(50)], "id long, entry string")
    got = {r.id: (r.before, r.after) for r in L.neighbours(rows, buckets=6).collect()}
    assert got == {i * 7: (f"e{i-1}" if i else None, f"e{i+1}" if i < 49 else None) for i in range(50)}


def test_models_are_found_by_fingerprint(spark, tmp_path):
    from pyspark.ml.feature import CountVectorizer, CountVectorizerModel

    rows = spark.createDataFrame([(["a", "b"],)], "words array<string>")
    key = models.fingerprint([1, 2], "counts", size=3)
    assert key == models.fingerprint([2, 1], "counts", size=3)
    assert models.find(spark, CountVectorizerModel, str(tmp_path), key) is None
    models.store(CountVectorizer(inputCol="words", outputCol="c").fit(rows), str(tmp_path), key)
    assert sorted(models.find(spark, CountVectorizerModel, str(tmp_path), key).vocabulary) == ["a", "b"]


def test_standing_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "arma\nx", "la", "a"), (2, "y", "la", "a")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ST.standing_search(ST.works_stream(spark, str(tmp_path / "in"), docs.schema), "arma")
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.work_id, r.idx) for r in spark.table("found").collect()] == [(1, 1)]

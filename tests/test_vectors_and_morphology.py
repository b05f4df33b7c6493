"""What SQL can't state: fitted models on planted data, refusals; Greek principal parts."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import lexicon as L
from lexiloom.operators import morphology as M
from lexiloom.operators import vectors as V

A, B = [f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]


@pytest.fixture(scope="module")
def sentences(spark):
    """Two topics that share no word."""
    rng = random.Random(2)
    rows = [(k, [rng.choice(A if k % 2 else B) for _ in range(20)]) for k in range(240)]
    return spark.createDataFrame(rows, "id long, words array<string>").cache()


def test_topics_part(sentences):
    rows = V.topics(sentences, k=2, most_share=0.95, terms=6, steps=20).collect()
    by_topic = [{r.word[0] for r in rows if r.topic == k and r.place <= 4} for k in (0, 1)]
    assert sorted(map(sorted, by_topic)) == [["a"], ["b"]]


def test_lsi_finds_the_topic_of_a_query(sentences):
    got = {r.id: r.similarity for r in V.lsi(sentences, ["a1", "a5"], k=2).collect()}
    assert min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if not k % 2) + 0.3


def test_latent_space_has_unit_rows_that_part_the_topics(sentences):
    rows = V.latent_space(sentences, k=2).collect()
    assert len(rows) == 240 and all(len(r.embedding) == 2 and abs(sum(x * x for x in r.embedding) - 1) < 1e-6 for r in rows)
    like = lambda a, b: sum(x * y for x, y in zip(a.embedding, b.embedding))
    one, other = ([r for r in rows if r.id % 2 == k] for k in (0, 1))
    assert min(like(one[0], r) for r in one) > max(like(one[0], r) for r in other) + 0.5


def test_lsi_of_unknown_words(sentences):
    assert {r.similarity for r in V.lsi(sentences, ["nothing"], k=2).collect()} == {0.0}


@pytest.mark.parametrize("words,terms,why", [(0, ["a"], "the scope is empty"), (9, [], "no term"), (99, ["a"], "99 words, more than 50"), (9, ["A", "q"], "unknown: q"), (9, ["a", "A"], None)])
def test_refusals(words, terms, why):
    assert V.refusal(words, terms, {"a"}, most_words=50) == why


def test_tfidf_candidates_lose_no_pair(spark):
    """The bound on common words against all pairs, for several thresholds."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "of", "and", *(f"w{rng.randrange(40)}" for _ in range(4))]) for _ in range(rng.randrange(1, 25)))) for k in range(60)]
    weights = V.tfidf(spark.createDataFrame(rows, "id long, t string"), "id", F.split("t", " "))
    held = {}
    for r in weights.collect():
        held.setdefault(r.id, {})[r.word] = r.w
    for least in (0.1, 0.4, 0.8):
        want = {(a, b): s for a in held for b in held if a < b and (s := sum(w * held[b].get(x, 0) for x, w in held[a].items())) >= least}
        got = {(r.a, r.b): r.similarity for r in V.similar_documents(weights, least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_greek_principal_parts(spark):
    rows = [("lyo", "lyo", "pres ind act 1st sg"), ("lyo", "lyso", "fut ind act 1st sg"), ("lyo", "elysa", "aor ind act 1st sg"), ("lyo", "lelyke", "perf ind act 3rd sg"), ("lyo", "lelymai", "perf ind mp 1st sg"), ("lyo", "elythe", "aor ind mid 3rd sg"), ("lyo", "lysas", "aor part act masc nom sg")]
    table = spark.createDataFrame(rows, "headword string, form string, analysis string")
    got = {(r.part, r.form, r.exact) for r in M.principal_parts(table, greek=True).collect()}
    assert got == {(1, "lyo", True), (2, "lyso", True), (3, "elysa", True), (4, "lelyke", False), (5, "lelymai", True), (6, None, False)}


def test_no_analyses(spark):
    none = spark.createDataFrame([], "headword string, form string, analysis string, n int")
    assert M.verb_table(none).count() == M.declension_table(none).count() == M.principal_parts(none, True).count() == M.known_attributes(none).count() == M.known_forms(none, "x").count() == 0


@pytest.mark.parametrize("method", ["flat", "alternates", "winner"])
def test_bags_in_place_are_those_by_joins(spark, monkeypatch, method):
    sentences = spark.createDataFrame([(1, 1, ["cats", "the", "cat", "x"]), (1, 2, ["the"]), (2, 1, []), (2, 2, ["cats", "cats", "new"])], "work_id long, sentence int, words array<string>")
    forms = spark.createDataFrame([("cats", "cat"), ("cats", "cats"), ("cat", "cat"), ("the", "the"), ("x", "x"), ("x", "the")], "form string, headword string")
    totals = spark.createDataFrame([("cat", 5), ("cats", 9), ("the", 3)], "headword string, total long")
    made = []
    for most in (V.MOST_BROADCAST_FORMS, 0):
        monkeypatch.setattr(V, "MOST_BROADCAST_FORMS", most)
        made.append(sorted(tuple(r) for r in V.bags(sentences, forms, totals, method, ["the"]).collect()))
    assert made[0] == made[1] == {
        "flat": [(1, 1, "cat cats cat"), (2, 2, "cat cats cat cats new")], "alternates": [(1, 1, "cat·cats cat"), (2, 2, "cat·cats cat·cats new")], "winner": [(1, 1, "cats cat"), (2, 2, "cats cats new")],
    }[method]


def test_ranks_over_ranges(spark):
    from lexiloom.operators import lexicon as L

    rows = [(f"e{k}", k % 7) for k in range(300)]
    got = {r.entry: r.place for r in L.ranked(spark.createDataFrame(rows, "entry string, total int").repartition(5), F.desc("total"), "entry").collect()}
    assert got == {e: k + 1 for k, (e, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_references_to_a_common_name_do_not_meet_all_its_entries(spark):
    """3000 references to one name and 3000 entries of it: entries are one for each name before they are joined."""
    entries = spark.range(3000).select("id", F.concat(F.lit("the"), F.when(F.col("id") % 2 == 0, "¹").otherwise("")).alias("entry"))
    asked = spark.range(3000).select(F.col("id").alias("xref"), F.when(F.col("id") % 3 == 0, "the²").otherwise("the").alias("entry"))
    found = L.by_cross_reference(asked, entries)
    assert {r.xref: (r.id, r.entry) for r in found.collect()} == {k: ((0, "the¹") if k % 3 == 0 else (1, "the")) for k in range(3000)}
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1:]
    assert len(below) == 2 and all("Aggregate [" in part for part in below)


def test_cooccurrence_shuffles_sums_only(spark):
    """A sentence's words are counted in its row; what is shuffled is a row for each word of a task."""
    sentences = spark.createDataFrame([(1, 1, ["the", "a", "a", "the"]), (1, 2, ["a", "b"]), (2, 1, ["the", "b", "the", "the"]), (3, 1, [])], "work_id long, sentence int, words array<string>")
    seen = []
    monkey = V.written
    try:
        V.written = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or monkey(df, name)
        got = {r.word: (r.together, r.cosine) for r in V.cooccurrence(sentences, "the").collect()}
    finally:
        V.written = monkey
    assert got == {"a": (4, round(4 / (5 * 13) ** 0.5, 6)), "b": (3, round(3 / (2 * 13) ** 0.5, 6))}
    assert len(seen) == 1 and seen[0].count("hashpartitioning(") == 1 and "hashpartitioning(word" in seen[0]


def test_common_words_are_not_shuffled_as_often_as_they_occur(spark, monkeypatch):
    """Bags of more forms than are broadcast: what is shuffled has a row for each form of a part; words stay in their sentences."""
    monkeypatch.setattr(V, "MOST_BROADCAST_FORMS", 0)
    sentences = spark.createDataFrame([(k % 7, k, ["the", "cats", "runs"] * 30) for k in range(200)], "work_id long, sentence int, words array<string>")
    forms = spark.createDataFrame([("the", "the"), ("cats", "cats"), ("cats", "cat"), ("runs", "run")], "form string, headword string")
    totals = spark.createDataFrame([("the", 9), ("cats", 2), ("cat", 2), ("run", 1)], "headword string, total long")
    found = V.bags(sentences, forms, totals, "flat", ["the"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
    assert {r.bag for r in found.collect()} == {" ".join(["cat cats run"] * 30)} and found.count() == 200


def test_pairs_of_one_table_are_compared_once(spark, monkeypatch):
    """Candidates of a table with itself have each pair once, none of a document with itself, and no row carries a document's words for each pair."""
    rng = random.Random(5)
    rows = [(k, [rng.choice("abcdefghijkl") * (1 + k % 3) for _ in range(8)]) for k in range(80)]
    docs = spark.createDataFrame(rows, "id long, words array<string>")
    weights = V.tfidf(docs, "id", F.col("words"))
    kept, write = {}, V.written
    monkeypatch.setattr(V, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(V, "BLOCK_DOCS", 10)
    got = {(r.query, r.doc): round(r.similarity, 9) for r in V.best_tfidf_matches(weights, weights, 0.6).collect() if r.query != r.doc}
    w = {}
    for r in weights.collect():
        w.setdefault(r.id, {})[r.word] = r.w
    want = {(a, b): round(s, 9) for a in w for b in w if a != b and (s := sum(x * w[b].get(k, 0) for k, x in w[a].items())) >= 0.6}
    assert got == want and len(want) > 20
    assert kept["tfidf_candidates"].where("query >= doc").count() == 0

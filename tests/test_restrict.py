import pytest
from pyspark.sql import functions as F

from lexiloom.operators import scope as P
from lexiloom.plans import restrict as R
from lexiloom.sources import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two corpora of two authors each, ten works an author."""
    folder = str(tmp_path_factory.mktemp("restrict"))
    rows = [(k, f"line {k}\nmore", ("en", "de")[k % 2], f"src{k % 4}", 10) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def chosen_of(spark, folder, scope):
    catalog = corpus.works_catalog(spark, folder)
    return catalog, P.compile_scope(catalog, corpus.authors(catalog), scope)


@pytest.mark.parametrize("scope,how,pushed", [
    (P.Scope(corpora=("en",)), "corpus", "In(lang, [en])|EqualTo(lang,en)"), (P.Scope(authors=("src1", "src2")), "author", "In(source, [src1,src2])"), (P.Scope(works=(3, 5, 9)), "work", "In(doc_id, [3,5,9])"),
    (P.Scope(), "all", None), (P.Scope(without_works=(2,)), "join", None), (P.Scope(works=(999,)), "work", None),
])
def test_the_scan_is_restricted_as_the_sizes_say(spark, tables, monkeypatch, scope, how, pushed):
    monkeypatch.setattr(R, "MOST_IDS", 500 if how == "work" else 3)
    catalog, chosen = chosen_of(spark, tables, scope)
    assert R.way(catalog, chosen)[0] == how
    rows = R.restricted(corpus.works(spark, tables), catalog, chosen).select("work_id", F.size("lines").alias("n"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    if pushed:
        assert "Join" not in plan and any(p in plan for p in pushed.split("|")), plan
    assert ("LeftSemi" in plan) == (how == "join")
    assert sorted(r.work_id for r in rows.collect()) == sorted(r.work_id for r in chosen.select("work_id").collect())

import os
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import search as S
from lexiloom.sources import corpus
from lexiloom.sources.postings import WordIndex

TEXTS = {k: f"The word{k % 7} and, the “Word{k % 3}”\nnone of it v{k} vox12 «»" + (" rare" if k in (4, 5) else "") for k in range(40)} | {9000: "rare rare\nthe end", 9001: None, 9002: ""}


def plain(texts):
    words, raws = Counter(), Counter()
    for t in texts.values():
        for w in (t or "").replace("\n", " ").split(" "):
            if w:
                raws[w.lower()] += 1
                bare = re.sub(r"[^\w]|[0-9_]", "", w.lower()).replace("v", "u")
                words[bare] += bool(bare)
    return +words, raws


def write(spark, folder, name, texts):
    rows = [(k, t, "en", "src1") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp_{name}")
    part = next(f for f in os.listdir(f"{folder}/tmp_{name}") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/documents.parquet", exist_ok=True)
    shutil.move(f"{folder}/tmp_{name}/{part}", f"{folder}/documents.parquet/{name}.parquet")
    shutil.rmtree(f"{folder}/tmp_{name}")


@pytest.fixture
def folder(spark, tmp_path):
    for lo in range(0, 40, 10):
        write(spark, tmp_path, f"part{lo}", {k: TEXTS[k] for k in range(lo, lo + 10)})
    write(spark, tmp_path, "last", {k: TEXTS[k] for k in (9000, 9001, 9002)} | {None: "no id, but rare"})
    return tmp_path


def index_of(spark, folder):
    return WordIndex(spark, str(folder), f"file://{folder}/index")


def counted(index, **how):
    return {r[0]: r.n for r in index.counts(**how).collect()}


def files_read(df):
    """Files that the scans of a collected plan opened."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().get("numFiles").get().value() for k in range(leaves.size()))


def test_counts_and_works_are_those_of_the_texts(spark, folder):
    index = index_of(spark, folder)
    assert index.refresh() == {"indexed": 44, "kept": 0, "removed": 0}
    words, raws = plain(TEXTS | {-1: "no id, but rare"})
    assert {w: n for w, n in counted(index).items() if w} == words
    assert counted(index, by="raw") == raws
    assert {r.work_id for r in index.holding(["rare"]).collect()} == {4, 5, 9000, None}
    assert index.known(["rare", "nothing", "uox"]) == ["rare", "uox"]
    assert [tuple(r) for r in S.rarest_term(index, ["the", "rare", "zzz"]).collect()] == [("zzz", 0), ("rare", raws["rare"]), ("the", raws["the"])]


def test_a_search_opens_only_files_with_works_that_hold_a_form(spark, folder):
    index = index_of(spark, folder)
    index.refresh()
    docs = index.docs_holding(["rare"])
    hits = S.simple(corpus.as_works(docs), S.holding(["rare"]))
    assert {(r.work_id, r.idx) for r in hits.collect()} == {(4, 2), (5, 2), (9000, 1), (None, 1)}
    rows = docs.where("doc_id is not null")
    rows.collect()
    assert files_read(rows) <= 3  # of five: part0 and last, and those without an id
    assert "PushedFilters: [In(doc_id" in rows._jdf.queryExecution().toString() or "doc_id IN" in rows._jdf.queryExecution().toString()
    assert index.docs_holding(["the"]).count() == 44  # most works: all are read


def test_only_what_changed_is_indexed_anew(spark, folder):
    index = index_of(spark, folder)
    index.refresh()
    assert index_of(spark, folder).refresh() == {"indexed": 0, "kept": 44, "removed": 0}
    texts = dict(TEXTS)
    texts[12] = "now rare and new"
    write(spark, folder, "part10", {k: texts[k] for k in range(10, 20)})
    again = index_of(spark, folder)
    assert not again.up_to_date()
    assert again.refresh() == {"indexed": 1, "kept": 43, "removed": 1}
    words, raws = plain(texts | {-1: "no id, but rare"})
    assert {w: n for w, n in counted(again).items() if w} == words and counted(again, by="raw") == raws
    assert {r.work_id for r in again.holding(["rare"]).collect()} == {4, 5, 12, 9000, None}
    os.remove(f"{folder}/documents.parquet/part20.parquet")
    last = index_of(spark, folder)
    assert last.refresh() == {"indexed": 0, "kept": 34, "removed": 10}
    words, _ = plain({k: t for k, t in texts.items() if not 20 <= k < 30} | {-1: "no id, but rare"})
    assert {w: n for w, n in counted(last).items() if w} == words
    assert {r.word: r.n for r in last.totals().where("word <> ''").collect()} == words


def test_pages_hold_a_bounded_number_of_works(spark, tmp_path):
    write(spark, tmp_path, "all", {k: "the" for k in range(9500)} | {-5: "the"})
    index = index_of(spark, tmp_path)
    index.refresh()
    assert sorted(r.n for r in index._rows(["the"]).select(F.size("offsets").alias("n")).collect()) == [1, 1308, 4096, 4096]
    assert {r.work_id for r in index.holding(["the"]).collect()} == {*range(9500), -5}


def test_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, "none", {})
    index = index_of(spark, tmp_path)
    assert index.refresh() == {"indexed": 0, "kept": 0, "removed": 0}
    assert counted(index) == {} and index.docs_holding(["the"]).count() == 0

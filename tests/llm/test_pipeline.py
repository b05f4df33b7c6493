import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import brute  # noqa: E402
from .test_models import labelled  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    good = [(i, t) for i, t in labelled(400) if i % 2]
    rows = [(i, t + (" You idiot scum!" if i % 20 == 1 else "") + f" {' '.join(f'u{rng.randrange(10**6)}' for _ in range(30))}") for i, t in good]
    rows += [(1000 + i, t) for i, t in rows[:30]]  # exact copies
    rows += [(i, t) for i, t in labelled(400) if not i % 2] + [(5001, None), (None, rows[3][1])]
    path = tmp_path_factory.mktemp("sf")
    brute.docs(spark, rows).select(*COLUMNS).write.parquet(str(path / "documents.parquet"))
    labels = [(i, i % 2, int(i % 20 == 1)) for i, _ in rows if i is not None and i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict((i, t) for i, t in rows if i is not None)


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "mix", "pieces"] and corpus_pipeline.ORACLE_SQL is None
    kept = stages["quality"](spark, docs, path)
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in texts if i % 2 and i < 1400} <= ids and not [i for i in texts if i % 2 == 0 and i < 400 and i in ids]
    once = stages["near_duplicates"](spark, kept, path)
    left = {r.doc_id for r in once.collect()}
    assert once.columns == COLUMNS and not any(i is not None and 1000 <= i < 1400 for i in left) and {i for i in ids if i is not None and i < 400} <= left
    mixed = stages["mix"](spark, once, path)
    rest = {r.doc_id for r in mixed.collect()}
    assert mixed.columns == COLUMNS and {i for i in left if i is not None and i < 400 and i % 20 != 1} <= rest
    last = stages["pieces"](spark, mixed, path).collect()
    assert len(last) == mixed.count() and all(r.round_trip for r in last)


def test_few_toxic_documents_go_and_shares_are_delivered(spark, tmp_path):
    """Toxic documents are 3 % and the labels without noise: less than any fixed share of the tokens would take out."""
    rng = random.Random(8)
    rows = [(i, t + " You idiot scum!" * (i % 66 == 1) + f" {' '.join(f'u{rng.randrange(10**6)}' for _ in range(30))}") for i, t in labelled(800) if i % 2]
    toxic = {i for i, _ in rows if i % 66 == 1}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = brute.docs(spark, rows).select(*COLUMNS)
    left = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [i for i, _ in rows if i not in toxic]
    model = corpus_pipeline.mixing.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ("toxic",))
    rated, target, fitted = corpus_pipeline.mixing.mix(docs, model, None, anchor="toxic0")
    held = {r.row.doc_id: (r.n_tokens, r.posterior) for r in rated.collect()}
    for k, name in enumerate(model.names):
        have = sum(held[r.doc_id][0] * held[r.doc_id][1][k] for r in left)
        assert abs(have - fitted[name]) <= 0.01 * sum(fitted.values()) and target[name] <= sum(n * p[k] for n, p in held.values())


CLASHES = ["score", "predicted", "score_", "predicted_", "text_", "place_", "row", "rate", "take_", "one_", "posterior", "n_tokens", "component_id", "kept", "id_", "label_", "a b.c"]


def test_extra_columns_with_clashing_names_and_repeated_ids(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 40"))  # rows several times over
    for k, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(k))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, path), f"clash_{name}")
        assert docs.columns == before.columns and docs.count() > 0, name
        assert docs.select(*(F.col(f"`{c}`") for c in CLASHES)).distinct().collect() == [tuple(range(len(CLASHES)))], name
    ids = [r.doc_id for r in docs.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids))
    assert corpus_pipeline.pieces(spark, docs, path).count() == docs.count()


def test_run_over_no_rows(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

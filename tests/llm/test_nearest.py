import numpy as np

from lexiloom.llm import nearest as N
from lexiloom.llm.cluster_tree import Tree

from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, every=10, k=10):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in fine if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def clustered(n, seed=0, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, size)) * 3
    return [(k, (centres[k % 8] + rng.standard_normal(size)).tolist()) for k in range(n)]


def test_recall_and_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 16)
    monkeypatch.setattr(N, "BLOCK_ROWS", 9)
    monkeypatch.setattr(N, "GROUP_ROWS", 7)
    rows = clustered(2500)
    rows += [(5000 + k, rows[7][1]) for k in range(900)] + [(9000, None), (9010, [0.0] * 12), (9020, [float("nan")] * 12), (9030, [None] + [1.0] * 11), (None, [1.0] * 12)]
    want = plain(rows)
    seen = []
    for parts in (1, 6):
        df = N.nearest_vectors(spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", leaf int, score double").repartition(parts), F.col("id") % 10 == 0)
        got = answers(df)
        assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
        hit = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
        assert hit >= 0.95 * 10 * len(want)
        assert all(v == sorted(v) for v in got.values())
        truth = {i: dict((j, d) for d, j in near) for i, near in plain(rows, k=10**6).items()}
        assert all(abs(truth[i][j] - d) < 1e-12 for i, v in got.items() for d, j in v)
        assert got[5000] == [(0.0, j) for j in [7, *range(5001, 5010)]]
        seen.append(got)
    assert seen[0] == seen[1]


def test_few_rows_mixed_lengths_repeats_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (10, [0.5]), (2, [3e200, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (30, [2.0] * 3)]
    got = answers(N.nearest_vectors(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0))
    assert [j for _, j in got[0]] == [20, 20, 1, 2] and [j for _, j in got[20]] == [0, 20, 1, 2]
    assert 10 not in got and 30 not in got
    assert got[0][-1][0] == 3e200
    table = spark.createDataFrame(rows, SCHEMA)
    assert N.nearest_vectors(table.limit(0), F.col("id") % 10 == 0).collect() == []
    assert N.nearest_vectors(table, F.lit(False)).collect() == []


def test_tree_visits_all_leaves_and_the_best_first():
    x = np.array([v for _, v in clustered(3000, 2)])
    tree = Tree.fit(x, 20)
    leaf = tree.leaf_of(x)
    held = np.bincount(leaf, minlength=tree.leaves)
    q, u = tree.visits(x[:40], tree.leaves, held, 1)
    assert len(q) == 40 * tree.leaves and len(set(zip(q, u))) == len(q)
    q, u = tree.visits(x[:40], 1, held, 1)
    assert (u[np.argsort(q)] == leaf[:40]).mean() > 0.8
    q, u = tree.visits(x[:40], 1, held, 100)
    assert all(held[u[q == k]].sum() >= 100 for k in range(40))
    assert Tree.fit(np.ones((50, 3)), 4).leaves == 1

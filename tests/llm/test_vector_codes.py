import hashlib

import numpy as np
import pytest

from lexiloom.llm import vector_codes as V


def plain(rows, parts=V.PARTS, entries=V.ENTRIES):
    """rows: (id, label, vector). Loops in whole numbers."""
    fine = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(fine[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in sorted(fine)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((far(v, e), k) for k, e in enumerate(book))
    for _ in range(V.ROUNDS):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, _, v in fine:
                mine[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for e, m in zip(books[p], mine)]
    out = {}
    for i, lab, v in fine:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab
    sums = {}
    for _, d, lab in out.values():
        sums[lab] = sums.get(lab, 0) + d
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, d, sums[lab], sha) for i, (c, d, lab) in out.items()}


def some_rows(n, seed, coarse):
    """Coarse vectors make many ties."""
    x = np.random.default_rng(seed).integers(-3, 4, (n, 32)) / 4 if coarse else np.random.default_rng(seed).standard_normal((n, 32)) / 5
    return [(3 * k, [None, 1, 2][k % 3], [float(v) for v in row]) for k, row in enumerate(x)]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_are_those_of_plain_loops(spark, coarse):
    rows = some_rows(260, 1, coarse)
    rows += [(1, 1, None), (2, 1, [float("nan")] * 32), (4, 2, [None] + [0.5] * 31), (5, 2, [float("inf")] + [0.5] * 31)]
    want = plain(rows)
    for parts in (1, 7):
        table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", code string, error double").repartition(parts)
        got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.vector_codes(table).collect()}
        assert got == want


def test_many_labels_take_the_salted_join(spark, monkeypatch):
    rows = some_rows(120, 2, False)
    table = spark.createDataFrame(rows, SCHEMA)
    want = V.vector_codes(table).collect()
    monkeypatch.setattr(V, "MOST_LABELS", 1)
    assert sorted(V.vector_codes(table).collect()) == sorted(want)


def test_trees_keep_the_lowest_index_of_equals():
    rng = np.random.default_rng(4)
    for n in (1, 3, 5, 64):
        books = [rng.integers(-2, 3, (n, 4)) for _ in range(3)]
        x = rng.integers(-3, 4, (500, 4))
        p = rng.integers(0, 3, 500)
        entry, d = V.Trees(books).nearest(p, x)
        for k in range(500):
            far = ((books[p[k]] - x[k]) ** 2).sum(axis=1)
            assert (d[k], entry[k]) == (far.min(), int(np.argmin(far)))


def test_few_rows_odd_lengths_and_none(spark):
    table = spark.createDataFrame([(7, 1, [0.5] * 5), (8, 1, [0.25] * 5), (None, 1, [0.5] * 5), (9, 1, [1.0] * 3), (6, 1, []), (8, 1, [1e30] * 5)], SCHEMA)
    rows = V.vector_codes(table).collect()
    assert sorted((r.vec_id or 0, len(r.code)) for r in rows) == [(0, 32), (7, 32), (8, 32), (8, 32)] and len({r.codebooks_sha256 for r in rows}) == 1
    assert {r.error for r in rows} == {0}  # each row is an entry of its own
    assert V.vector_codes(table.limit(0)).collect() == [] and V.vector_codes(table.where("vec_id = 6")).collect() == []

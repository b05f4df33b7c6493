"""Operator 13: nearest vectors by a hierarchical k-means tree that is searched best bin first.

Equal vectors form a class with its smallest ids (as many as an answer can use). A tree of k-means clusters is fitted on the driver to a
bounded sample of the classes (SAMPLE_ROWS of those of smallest hash, fewer where vectors are long); every class goes down to a leaf. Leaves side by side
make a bin, to which a query goes once and from which it gets one answer; a leaf with many classes is dealt to blocks, and a bin's visitors to groups,
so that no task holds more than about BLOCK_ROWS classes and GROUP_ROWS queries.
A query opens the tree's nodes by a priority queue and visits leaves, nearest first; how many is calibrated: CALIBRATION queries of
smallest hash are compared with all classes by brute force, and the visits grow by a quarter until the leaves visited hold RECALL of their true
neighbours (all leaves hold all of them, so that it always ends). A query goes on until its leaves hold enough rows to answer it. Distances are taken
in double precision from the original vectors.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component take no part, nor do null ids. Only vectors of a
query's own length are its candidates. Rows alike in id and vector are one query, and answered once; of rows that share its id and vector a query leaves out one as
its own. Equal distances go to the smaller id. calibrated_recall is the least recall of a length's calibration. Other columns are ignored, whatever their names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster_tree import Tree
from .embedding_dup import usable
from .shared import mapped, written

NEIGHBOURS = 10
#: Classes that the tree is fitted to, and the most values that they may hold together.
SAMPLE_ROWS, SAMPLE_VALUES = 32_768, 4_194_304
#: Classes a leaf holds, about (while the sample has LEAST_ROWS of them).
LEAF_ROWS, LEAST_ROWS = 128, 8
BLOCK_ROWS, GROUP_ROWS = 4096, 32_768
CALIBRATION, RECALL = 256, 0.95
#: Queries that are compared with a block or led through the tree at a time.
QUERIES = 256


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _by_length(column):
    """(length, rows, matrix) for each length of vectors in an Arrow list column."""
    size = np.diff(np.asarray(column.offsets))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, _matrix(column if len(rows) == len(size) else column.take(rows))


def _distance(off: np.ndarray) -> np.ndarray:
    """Lengths of rows; those whose squares would overflow are scaled first."""
    most = np.abs(off).max(axis=1, initial=0)
    scale = np.where(most > 1e150, most, 1.0)
    return np.sqrt(((off / scale[:, None]) ** 2).sum(axis=1)) * scale if (scale > 1).any() else np.sqrt((off**2).sum(axis=1))


def closest(q: np.ndarray, x: np.ndarray, least_id: np.ndarray, k: int):
    """(query, row of x, distance) of the k nearest rows of each query, ties to the smaller id: chosen by products (rows that rounding
    could have put behind the k-th come along), measured by differences."""
    scale = max(1.0, np.abs(q).max(initial=0) / 1e150, np.abs(x).max(initial=0) / 1e150)
    a, b = (q / scale, x / scale) if scale > 1 else (q, x)
    square, own = (b * b).sum(axis=1), (a * a).sum(axis=1)
    near = square - 2 * (a @ b.T) + own[:, None]
    kth = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    r, c = np.nonzero(near <= (kth + 1e-9 * (own + square.max(initial=0)))[:, None])
    d = _distance(q[r] - x[c])
    order = np.lexsort((least_id[c], d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.searchsorted(r, r)
    top = np.arange(len(r)) - first < k
    return r[top], c[top], d[top]


def _answers(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, ids: list, k: int):
    """(query, id, row of x, distance) of each query's k nearest rows, its own left out once."""
    least = np.array([i[0] for i in ids], np.int64)
    out = []
    for lo in range(0, len(q), QUERIES):
        r, c, d = closest(q[lo : lo + QUERIES], x, least, k + 1)
        n = np.array([len(ids[j]) for j in c], np.int64)
        row = np.repeat(np.arange(len(r)), n)
        each = np.array([i for j in c for i in ids[j]], np.int64)
        own = (each == q_id[lo + r[row]]) & (x[c[row]] == q[lo + r[row]]).all(axis=1)
        own &= ~np.concatenate([[False], own[1:] & own[:-1] & (row[1:] == row[:-1])]) if len(own) else own  # one row only
        row, each = row[~own], each[~own]
        order = np.lexsort((each, d[row], r[row]))
        row, each = row[order], each[order]
        top = np.arange(len(row)) - np.searchsorted(r[row], r[row]) < k
        out.append((lo + r[row[top]], each[top], c[row[top]], d[row[top]]))
    return [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]


def _measured(trees: dict, asked: dict, k: int):
    """Over a task's classes: how many each leaf gets (q -1: leaf, classes in id, ids in rest), and the nearest of each calibration query."""

    def run(batches):
        import pyarrow as pa

        classes, rows, best = {}, {}, {}
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            for n, at, x in _by_length(batch.column(batch.schema.get_field_index("vector"))):
                tree, base = trees[n]
                leaf = tree.leaf_of(x)
                for u, c in zip(*np.unique(leaf, return_counts=True)):
                    classes[base + u] = classes.get(base + u, 0) + int(c)
                for u, i in zip(leaf, at):
                    rows[base + u] = rows.get(base + u, 0) + len(ids[i])
                if n in asked:
                    q, q_id, names = asked[n]
                    r, each, c, d = _answers(q, q_id, x, [ids[i] for i in at], k)
                    old = best.get(n)
                    new = [names[r], d, each, base + leaf[c]]
                    new = [np.concatenate(v) for v in zip(old, new)] if old else new
                    order = np.lexsort((new[2], new[1], new[0]))
                    new = [v[order] for v in new]
                    top = np.arange(len(order)) - np.searchsorted(new[0], new[0]) < k
                    best[n] = [v[top] for v in new]
        leaves = sorted(classes)
        zero = np.zeros(len(leaves))
        parts = [[np.full(len(leaves), -1), zero, np.array([classes[u] for u in leaves]), np.array(leaves), np.array([rows[u] for u in leaves])], *([*b, np.zeros(len(b[0]))] for b in best.values())]
        q, d, i, u, m = (np.concatenate(v) for v in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.float64()), pa.array(i.astype(np.int64)), pa.array(u.astype(np.int32)), pa.array(m.astype(np.int64))], names=["q", "score", "id", "leaf", "rest"])

    return run


def _placed(trees: dict, bin_of: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            leaf = np.zeros(len(column), np.int32)
            for n, at, x in _by_length(column):
                leaf[at] = trees[n][1] + trees[n][0].leaf_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(bin_of[leaf].astype(np.int32))], names=[*batch.schema.names, "leaf", "bin"])

    return run


def _visited(trees: dict, width: dict, held: np.ndarray, least: int, bin_of: np.ndarray):
    """For each query and bin the leaves that it visits there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for n, at, q in _by_length(batch.column(batch.schema.get_field_index("vector"))):
                if n not in trees:
                    continue
                tree, base = trees[n]
                for lo in range(0, len(q), QUERIES):
                    r, leaf = tree.visits(q[lo : lo + QUERIES], width[n], held[base : base + tree.leaves], least)
                    leaf += base
                    order = np.lexsort((leaf, r))
                    r, leaf = r[order], leaf[order]
                    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (bin_of[leaf[1:]] != bin_of[leaf[:-1]])]))
                    leaves = pa.ListArray.from_arrays(pa.array(np.append(new, len(r)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
                    row = pa.array(at[lo + r[new]])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(bin_of[leaf[new]].astype(np.int32)), leaves], names=["q_id", "q_hash", "bin", "leaves"])

    return run


def _searched(k: int):
    """A bin's leaves, each against its visitors; a query's nearest of all of them go on."""

    def run(classes, queries):
        import pyarrow as pa

        schema = pa.schema([("q_id", pa.int64()), ("q_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not classes.num_rows or not queries.num_rows:
            return schema.empty_table()
        q_id, q, x = queries.column("q_id").to_numpy(), _matrix(queries.column("q_vector")), _matrix(classes.column("vector"))
        ids, home = classes.column("ids").to_pylist(), classes.column("leaf").to_numpy()
        leaves = queries.column("leaves").combine_chunks()
        visitor, leaf = np.repeat(np.arange(len(q)), np.diff(np.asarray(leaves.offsets))), np.asarray(leaves.flatten())
        parts = []
        for u in np.unique(home):
            here, who = np.flatnonzero(home == u), visitor[leaf == u]
            if len(who):
                r, each, _, d = _answers(q[who], q_id[who], x[here], [ids[i] for i in here], k)
                parts.append((who[r], each, d))
        if not parts:
            return schema.empty_table()
        r, each, d = (np.concatenate(v) for v in zip(*parts))
        order = np.lexsort((each, d, r))
        r, each, d = r[order], each[order], d[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r = r[top]
        return pa.table([pa.array(q_id[r]), pa.array(queries.column("q_hash").to_numpy()[r]), pa.array(each[top]), pa.array(d[top])], schema=schema)

    return run


def _bins(trees: dict, in_leaf: np.ndarray) -> np.ndarray:
    """The bin of each leaf: leaves of one tree that follow each other, of BLOCK_ROWS classes at most together (or one leaf of more)."""
    out, now, rows = np.zeros(len(in_leaf), np.int64), -1, 0
    for tree, base in trees.values():
        for u in range(base, base + tree.leaves):
            if u == base or rows + in_leaf[u] > BLOCK_ROWS:
                now, rows = now + 1, 0
            out[u], rows = now, rows + in_leaf[u]
    return out


def _sample(classes: DataFrame, length: int, count: int) -> np.ndarray:
    """Of the classes of one length those of smallest hash: all, or about as many as the bounds allow."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // length))
    wide = 2**30
    rows = classes.where((F.size("vector") == length) & (F.pmod("h", F.lit(wide)) < int(min(1.0, 1.1 * most / count) * wide)))
    found = rows.select("h", "vector").toArrow()
    return _matrix(found.column("vector"))[np.argsort(found.column("h").to_numpy(), kind="stable")[:most]]


def nearest_vectors(vectors: DataFrame, is_query, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, calibrated_recall: the k nearest found for each row that is_query (a Column over `id`) picks."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("h", F.xxhash64("vector"))
    # row_number up to a bound is limited before the shuffle too: a task sends k + 1 rows of a vector at most
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = written(ranked.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nearest_classes")
    queries = written(rows.where(is_query).select(F.col("id").alias("q_id"), F.col("h").alias("q_hash"), "vector").distinct(), "nearest_queries")
    count = {r.n: r["count"] for r in classes.groupBy(F.size("vector").alias("n")).count().collect()}  # one row a length
    trees: dict[int, tuple[Tree, int]] = {}
    for n, rows_ in sorted(count.items()):
        sample = _sample(classes, n, rows_)
        base = sum(t.leaves for t, _ in trees.values())
        trees[n] = Tree.fit(sample, max(LEAST_ROWS, LEAF_ROWS * len(sample) // rows_)), base
    first = queries.orderBy(F.xxhash64("q_id"), "q_id", "q_hash").limit(CALIBRATION).toArrow()
    asked = {n: (x, first.column("q_id").to_numpy()[at], at) for n, at, x in _by_length(first.column("vector").combine_chunks())} if first.num_rows else {}
    measured = written(mapped(classes, _measured(trees, asked, k), "q int, score double, id long, leaf int, rest long"), "nearest_measured")
    leaves = measured.where("q < 0").groupBy("leaf").agg(F.sum("id").alias("classes"), F.sum("rest").alias("rows")).collect()  # one row a leaf: bounded by the sample
    held, in_leaf = (np.zeros(sum(t.leaves for t, _ in trees.values()), np.int64) for _ in range(2))
    for r in leaves:
        held[r.leaf], in_leaf[r.leaf] = r.rows, r.classes
    best = Window.partitionBy("q").orderBy("score", "id")
    truth = measured.where("q >= 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("q", "leaf").collect()
    width, reached = {}, 1.0
    for n, (tree, base) in trees.items():
        width[n], got = 1, 1.0
        if n in asked:
            names = {int(q): j for j, q in enumerate(asked[n][2])}
            want = np.array([(names[r.q], r.leaf - base) for r in truth if r.q in names], np.int64).reshape(-1, 2)
            while len(want):
                hit = np.zeros((len(names), tree.leaves), bool)
                hit[tree.visits(asked[n][0], width[n], held[base : base + tree.leaves], k + 1)] = True
                got = float(hit[want[:, 0], want[:, 1]].mean())
                if got >= recall or width[n] >= tree.leaves:
                    break
                width[n] = min(width[n] + max(1, width[n] // 4), tree.leaves)
        reached = min(reached, got)
    bin_of = _bins(trees, in_leaf)
    visits = written(mapped(queries, _visited(trees, width, held, k + 1, bin_of), "q_id long, q_hash long, bin int, leaves array<int>"), "nearest_visits")
    visitors = {r.bin: r["count"] for r in visits.groupBy("bin").count().collect()}  # one row a bin
    in_bin = np.bincount(bin_of, weights=in_leaf, minlength=1)
    plan = spark.createDataFrame([(u, -(-int(in_bin[u]) // BLOCK_ROWS), -(-c // GROUP_ROWS)) for u, c in sorted(visitors.items())], "bin int, blocks int, groups int")
    deal = lambda *by: F.xxhash64(F.lit(7), *by)
    left = mapped(classes, _placed(trees, bin_of), "h long, vector " + dict(classes.dtypes)["vector"] + ", ids array<long>, leaf int, bin int").join(F.broadcast(plan), "bin")
    left = left.select("bin", F.pmod(deal("h"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "leaf", "vector", "ids")
    right = visits.join(queries.withColumnRenamed("vector", "q_vector"), ["q_id", "q_hash"]).join(F.broadcast(plan), "bin").where("blocks > 0")
    right = right.select("bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(deal("q_id", "q_hash"), "groups").cast("int").alias("group"), "q_id", "q_hash", "leaves", "q_vector")
    keys = ["bin", "block", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_searched(k), "q_id long, q_hash long, vec_id long, score double")
    order = Window.partitionBy("q_id", "q_hash").orderBy("score", "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(reached).alias("calibrated_recall"))

"""Operator 12: vectors as codes of their parts, by product quantisation over whole numbers.

Each component x becomes floor(256 * x); a vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries. In each round the driver builds a kd-tree of every codebook and sends the trees along (PARTS * ENTRIES small entries: bounded);
tasks search them by branch and bound, where a branch whose box is exactly as near as the best entry so far is visited too, so
that of equally near entries the one of lowest index stays. A task adds up its rows by part and entry; Spark adds up the tasks' sums, and
one row for each part and entry comes back. Everything is a whole number, so no cut of the table changes a result.

Defined results: a vector that is null, empty or holds a null, NaN or infinite component has no row, nor has one whose length isn't that of the row
with the smallest id kept. Null ids are coded like others but start no codebook; rows of one id go by their components. With fewer than
ENTRIES such rows a codebook has as many entries. A length that PARTS doesn't divide is cut at floor(k * length / PARTS). Components
beyond +-2^19 count as 2^19 (so that an error of 2^13 components fits a long). Null labels are one label. Other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Whole components are at most this large; squares of differences then add up in 64 bits for 2^5 components a part.
LARGEST = 2**27
#: Entries of a leaf of a tree.
LEAF = 4
#: Rows that a task searches at a time.
ROWS = 2048
#: Sums by label up to this number of labels are broadcast; beyond it they are joined by shuffle, rows dealt to SALTS a label.
MOST_LABELS = 50_000
SALTS = 16
_FAR = np.iinfo(np.int64).max


class Trees:
    """A balanced kd-tree for each of some codebooks, all of one shape: node k has the children 2k and 2k + 1, the leaves come last."""

    def __init__(self, books: list[np.ndarray]):
        self.books, most = books, max(len(b) for b in books)
        self.depth = max(0, int(np.ceil(np.log2(max(1, most) / LEAF))))
        self.first_leaf = 2**self.depth
        slots = max(1, -(-most // self.first_leaf))
        wide = max(b.shape[1] for b in books)
        shape = (len(books), 2 * self.first_leaf)
        self.low, self.high = np.zeros((*shape, wide), np.int64), np.zeros((*shape, wide), np.int64)
        self.empty = np.ones(shape, bool)
        self.entry = np.full((len(books), self.first_leaf, slots), -1, np.int64)
        self.at = np.zeros((len(books), self.first_leaf, slots, wide), np.int64)
        for p, book in enumerate(books):
            self._node(p, 1, np.arange(len(book)), np.pad(book, ((0, 0), (0, wide - book.shape[1]))))

    def _node(self, p: int, node: int, entries: np.ndarray, book: np.ndarray) -> None:
        if not len(entries):
            return
        own = book[entries]
        self.empty[p, node], self.low[p, node], self.high[p, node] = False, own.min(axis=0), own.max(axis=0)
        if node >= self.first_leaf:
            self.entry[p, node - self.first_leaf, : len(entries)] = entries
            self.at[p, node - self.first_leaf, : len(entries)] = own
            return
        widest = int(np.argmax(self.high[p, node] - self.low[p, node]))
        entries = entries[np.argsort(own[:, widest], kind="stable")]
        half = (len(entries) + 1) // 2
        self._node(p, 2 * node, entries[:half], book)
        self._node(p, 2 * node + 1, entries[half:], book)

    def _bound(self, p: np.ndarray, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The squared distance from x to the box of a node."""
        off = np.maximum(np.maximum(self.low[p, node] - x, x - self.high[p, node]), 0)
        return np.where(self.empty[p, node], _FAR, (off * off).sum(axis=1))

    def nearest(self, p: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest entry of codebook p and its squared distance. All rows go down their own trees in lock-step, each with
        its stack of open branches, the nearer branch on top."""
        n = len(x)
        best, found = np.full(n, _FAR), np.full(n, -1, np.int64)
        stack, bound = np.ones((n, self.depth + 2), np.int64), np.zeros((n, self.depth + 2), np.int64)
        size = np.ones(n, np.int64)
        live = np.arange(n)
        while len(live):
            size[live] -= 1
            top = size[live]
            node, near = stack[live, top], bound[live, top]
            open_ = (near <= best[live]) & ~self.empty[p[live], node]  # as near as the best: a lower index may be in there
            row, node = live[open_], node[open_]
            leaf = node >= self.first_leaf
            if leaf.any():
                r, k = row[leaf], node[leaf] - self.first_leaf
                entry = self.entry[p[r], k]
                off = self.at[p[r], k] - x[r, None, :]
                d = np.where(entry < 0, _FAR, (off * off).sum(axis=2))
                for s in range(d.shape[1]):
                    better = (d[:, s] < best[r]) | ((d[:, s] == best[r]) & (entry[:, s] >= 0) & (entry[:, s] < found[r]))
                    best[r[better]], found[r[better]] = d[better, s], entry[better, s]
            if not leaf.all():
                r, k = row[~leaf], node[~leaf]
                left, right = self._bound(p[r], 2 * k, x[r]), self._bound(p[r], 2 * k + 1, x[r])
                swap = right < left
                t = size[r]
                stack[r, t], bound[r, t] = np.where(swap, 2 * k, 2 * k + 1), np.where(swap, left, right)
                stack[r, t + 1], bound[r, t + 1] = np.where(swap, 2 * k + 1, 2 * k), np.where(swap, right, left)
                size[r] += 2
            live = live[size[live] > 0]
        return found, best


def _cuts(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def _searched(batch, trees: Trees, cuts: list[int]):
    """(first row, rows x parts of entries, of squared distances, and the rows' components) for blocks of an Arrow batch."""
    column = batch.column(batch.schema.get_field_index("whole"))
    whole = np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), cuts[-1])
    parts, wide = len(cuts) - 1, trees.low.shape[2]
    for lo in range(0, len(whole), ROWS):
        x = whole[lo : lo + ROWS]
        cut = np.zeros((parts, len(x), wide), np.int64)
        for p in range(parts):
            cut[p, :, : cuts[p + 1] - cuts[p]] = x[:, cuts[p] : cuts[p + 1]]
        entry, error = trees.nearest(np.repeat(np.arange(parts), len(x)), cut.reshape(-1, wide))
        yield lo, entry.reshape(parts, len(x)), error.reshape(parts, len(x)), cut


def _sums(trees: Trees, cuts: list[int]):
    parts, wide = len(cuts) - 1, trees.low.shape[2]
    entries = max(len(b) for b in trees.books)

    def run(batches):
        import pyarrow as pa

        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            for _, entry, _, cut in _searched(batch, trees, cuts):
                for p in range(parts):
                    count[p] += np.bincount(entry[p], minlength=entries)
                    order = np.argsort(entry[p], kind="stable")
                    used, first = np.unique(entry[p][order], return_index=True)
                    total[p, used] += np.add.reduceat(cut[p][order], first, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *(pa.array(total[p, e, k]) for k in range(wide))], names=["part", "entry", "n", *(f"s{k}" for k in range(wide))])

    return run


def _codes(trees: Trees, cuts: list[int]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            code, error = [], []
            for _, entry, off, _ in _searched(batch, trees, cuts):
                code += [bytes(row).hex() for row in entry.T.astype(np.uint8)]
                error.append(off.sum(axis=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(np.concatenate(error) if error else [], pa.int64())], names=["id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order, in decimal, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def codebooks(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> tuple[list[np.ndarray], list[int]]:
    """rows: id, whole (array<long>), all of one length. The codebooks after the rounds, and the cuts of the parts."""
    first = np.array([r.whole for r in rows.where("id is not null").orderBy("id", "whole").limit(entries).collect()], dtype=np.int64)
    if not first.size:
        return [], []
    cuts = _cuts(first.shape[1], parts)
    books = [first[:, a:b] for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        trees = Trees(books)
        wide = trees.low.shape[2]
        schema = "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(wide))
        sums = mapped(rows.select("whole"), _sums(trees, cuts), schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(wide)))
        books = [b.copy() for b in books]
        for r in sums.collect():  # parts * entries rows
            books[r.part][r.entry] = [int(r[f"s{k}"]) // r.n for k in range(books[r.part].shape[1])]
    return books, cuts


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, whole: the rows that are coded, their components as whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))
    limit = float(LARGEST)
    rows = rows.select("id", "label", F.transform("vector", lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-limit)), F.lit(limit)))).alias("whole"))
    first = rows.where("id is not null").agg(F.min(F.struct("id", "whole")).alias("x")).select(F.size("x.whole").alias("n")).first().n
    return rows.where(F.size("whole") == F.lit(first))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 for every coded row."""
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    books, cuts = codebooks(rows)
    kind = dict(rows.dtypes)["label"]
    if not books:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256")).limit(0)
    coded = written(mapped(rows, _codes(Trees(books), cuts), f"id long, label {kind}, code string, error long"), "vector_codes")
    total = written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    if total.count() <= MOST_LABELS:
        out = coded.join(F.broadcast(total), F.col("label").eqNullSafe(F.col("of")))
    else:  # a hot label's rows are dealt to salts, each of which has the label's sum
        salted = total.select("of", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
        out = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    return out.select(F.col("id").alias(id_col), "code", "error", F.col("label_error").cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rows in SQL, for vectors whose length PARTS divides."""
    far = "list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = lambda k: f"a{k} AS (SELECT vec_id, part, any_value(c) AS c, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.vec_id, part, p.c, b.entry, {far} AS d FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, part)"
    update = lambda k: (
        f"m{k} AS (SELECT part, entry, list(s ORDER BY j) AS c FROM (SELECT part, entry, j, (sum(c[j]) // count(*) - CASE WHEN sum(c[j]) < 0 AND sum(c[j]) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS s FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j FROM a{k}) GROUP BY part, entry, j) GROUP BY part, entry),\n"
        f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"
    )
    return f"""WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS c FROM k, range({PARTS}) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
{assign(0)}, {update(0)}, {assign(1)}, {update(1)}, {assign(2)},
e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS digest FROM (SELECT part, entry, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS j FROM b2))
SELECT e.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM e JOIN k USING (vec_id), s"""

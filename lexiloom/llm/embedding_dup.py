"""Operator 4: near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors form a class, and only classes go on. Classes are dealt to shards by hash; each shard's graph is built in one task,
written to the shared folder, and audited against brute force: on a sample of its rows, on vectors planted just above the bound from
them, and on AUDITED vectors of all shards, its beam widened until the recall holds. Every class queries every shard
in blocks, and a task reads its shard's graph once for the blocks that follow each other; so the shuffle holds each vector once a shard, and no graph.
What a beam finds near enough is followed along links, so that a group of copies larger than the beam is found whole.
Found pairs are verified by cosine in double precision; each task sends a count for each query and the links of a spanning
forest of what it found, not all pairs; components join the forests.

A shard holds at most SHARD_ROWS classes, so their number grows with the table and every row still asks each of them: that part
of the work grows with the square of the table over SHARD_ROWS, which is raised where executors have more memory (about 0.6 KB a
row of 64 floats).

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinite component links with nothing, nor do
vectors of different lengths; such a row is its own component. All rows of one id are one node; a null id has no component and is
kept. n_links counts other rows. audited_recall is the least of the shards' recalls (1.0 without shards). Labels and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .components import components
from .hnsw import Graph, unit
from .shared import fresh_dir, written

COSINE = 0.95
SHARD_ROWS = 50_000
LEAST_SHARDS = 4
BLOCK_ROWS = 16_384
#: Vectors of all shards, those with the smallest hash of their id, that every shard's audit asks for beside its own.
AUDITED = 256
#: Graphs search in single precision, this much below the bound; double precision decides.
SLACK = 1e-4


def usable(vector):
    """Column: whether a vector can link at all."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


_SHARD = "dim int, shard int, path string, width int, recall double"


def _build(folder: str, audit: np.ndarray, least: float):
    def run(key, table):
        import pyarrow as pa
        from pyarrow import fs

        x = unit(_matrix(table.column("vector")))
        graph = Graph.build(x)
        width, recall = graph.audited_width(least - SLACK, audit if audit.shape[-1:] == x.shape[1:] else None)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        held = io.BytesIO()
        graph.dump(held, exact=x, ids=table.column("rep").to_numpy(), copies=table.column("copies").to_numpy())
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(held.getvalue())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "path": [f"{folder}/{name}"], "width": pa.array([width], pa.int32()), "recall": pa.array([recall])})

    return run


_last: dict[str, tuple] = {}  # the graph that this worker read last


def _graph(path: str):
    if path not in _last:
        from pyarrow import fs

        _last.clear()
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at, compression=None) as stream:
            graph, more = Graph.load(io.BytesIO(stream.read()))
        _last[path] = graph, more["exact"], more["ids"], more["copies"]
    return _last[path]


def _query(least: float, shards: dict):
    def run(key, queries):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        place = shards.get((key[0].as_py(), key[1].as_py()))
        if place is None:  # a shard without vectors of this length
            return schema.empty_table()
        path, width = place
        graph, exact, ids, copies = _graph(path)
        own = queries.column("rep").to_numpy()
        q = unit(_matrix(queries.column("vector")))
        found = graph.near(q.astype(np.float32), width, least - SLACK)
        names, at = np.unique(np.concatenate([ids, own]), return_inverse=True)
        member, asker = at[: len(ids)], at[len(ids) :]
        tree = np.arange(len(names))  # the tree that each node is in so far
        out = []
        for k, hits in enumerate(found):
            if not len(hits):
                continue
            hits = hits[exact[hits] @ q[k] >= least]
            hits = hits[ids[hits] != own[k]]
            if not len(hits):
                continue
            out.append((own[k], None, int(copies[hits].sum())))
            trees, first = np.unique(tree[member[hits]], return_index=True)
            apart = trees != tree[asker[k]]
            if apart.any():
                out += [(own[k], ids[hits[f]], None) for f in first[apart].tolist()]
                tree[np.isin(tree, trees[apart])] = tree[asker[k]]
        a, b, n = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, n_links, component_id, kept, audited_recall for every row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    known = rows.where("vector is not null and id is not null")
    classes = written(known.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "vector_classes")
    count = classes.count()
    shards = max(LEAST_SHARDS, -(-count // shard_rows))
    blocks = max(2, -(-count // BLOCK_ROWS))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    sample = classes.where(F.col("dim") == classes.agg(F.max("dim")).first()[0]).orderBy(F.xxhash64("rep"), "rep").limit(AUDITED).select("vector").collect()
    audit = unit(np.array([r.vector for r in sample])) if sample else np.zeros((0, 0))
    graphs = written(placed.groupBy("dim", "shard").applyInArrow(_build(fresh_dir(vectors.sparkSession, "graphs"), audit, cosine), _SHARD), "graphs")
    held = {(r.dim, r.shard): (r.path, r.width) for r in graphs.select("dim", "shard", "path", "width").collect()}  # one row a shard
    recall = graphs.agg(F.min("recall")).first()[0]
    asked = classes.select("dim", "rep", "vector", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = asked.groupBy("dim", "shard", "block").applyInArrow(_query(cosine, held), "a long, b long, links long")
    found = written(found, "vector_links")
    # rows of one id in several classes are one node
    ids = known.join(classes.select("vector", "rep"), "vector").select("id", "rep").distinct()
    parts = components(found.where("b is not null").select("a", "b").union(ids.where("id <> rep").join(known.groupBy("id").agg(F.count_distinct("vector").alias("c")).where("c > 1"), "id").select("id", "rep")))
    per_class = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    marked = classes.join(per_class.withColumnRenamed("a", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    marked = marked.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(marked, "vector", "left").select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("audited_recall", F.lit(1.0 if recall is None else float(recall)))

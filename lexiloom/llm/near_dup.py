"""Operator 2: near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct 5-word shingles; its sketch is the K smallest. Documents of equal sets form a
class, and only classes go on. Inverted lists of retained values give candidate pairs; the union sketch of a pair (the K smallest
of both sketches together) estimates their Jaccard similarity and filters; pairs that pass are verified on their full sets.

No list is expanded into all its pairs at first. Round 1 pairs every member of a list with the list's two hubs: the member whose
sketch is shared most, and one picked by hash, another for each list. What verifies is joined into components. Round 2 takes the
pairs left between different components. It needs only the shortest lists of each sketch: two sketches of K values that share
LEAST_SHARED of them share one among the K - LEAST_SHARED + 1 that come first when values are ordered by the length of their lists.
So a passage that many documents share drops out, unless a document is little else. Lists of at most SHORT_LIST such members are
compared whole. In longer ones, most members of which round 1 has joined into one component, all others are compared with all
members, block by block: in round 2 by the shared values of their sketches, and of each document the AT_FIRST likeliest that share
LIKELY of them are verified, which joins most of them; in round 3, where a list still holds several components, on their full sets inside the task,
which sends back no pairs but the links of a spanning forest. So no pair of a list is left out. The work of round 3 grows with the
documents outside times the members of their lists.

Defined results: null and empty texts have an empty set and no links; fewer words than a shingle make one shingle of them all;
all rows of one id are one node of the graph (each row keeps its own n_shingles); a null id has a null component and is kept.
Other columns are ignored, whatever their names. A pair at the similarity of 0.75 shares no value of its sketches with
probability 0.25^K, and fails the estimate (LEAST_ESTIMATE) with one of about 2e-6.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .components import components
from .shared import give_back, mapped, mix, shingle_hashes, text_chunks, words, written

K = 32
WIDTH = 5
#: Lists up to this length are compared whole in round 2.
SHORT_LIST = 64
LEAST_SHARED = 12
LEAST_ESTIMATE = LEAST_SHARED / K
#: Members of a long list that meet in one task, on each side, about, and the shingles of their sets.
BLOCK = 1024
BLOCK_SHINGLES = 500_000
#: Pairs from long lists that round 2 verifies of each document, and the share of values that their sketches have in common at least.
AT_FIRST = 4
LIKELY = 0.7
#: Ids are broadcast to filter texts up to this many (8 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST_IDS = 500_000

_ROW_BITS = 12
_HASH_BITS = np.uint64(64 - _ROW_BITS)
_MASK = np.uint64((1 << (64 - _ROW_BITS)) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Distinct 52-bit shingle hashes of each text, ascending, laid end to end, and the count of each text."""
    n = len(offsets) - 1
    _, _, doc, h = words(data, offsets)
    sh, of = shingle_hashes(h, doc, n, width)
    key = np.sort((of.astype(np.uint64) << _HASH_BITS) | (sh >> np.uint64(_ROW_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & _MASK).astype(np.int64), np.bincount((key >> _HASH_BITS).astype(np.int64), minlength=n)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, n_shingles, d1 and d2 (a digest of the whole set), sketch (its k smallest hashes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text_", most_rows=1 << _ROW_BITS):
                hashes, count = shingle_sets(data, offsets, width)
                first = np.cumsum(count) - count
                some = np.flatnonzero(count)
                d1, d2 = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
                if len(some):
                    m = mix(hashes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
                    d1[some] = np.add.reduceat(m, first[some])
                    d2[some] = np.add.reduceat(mix(m ^ np.uint64(0x9E3779B97F4A7C15)), first[some])
                kept = np.minimum(count, k)
                ends = np.cumsum(kept)
                at = np.arange(int(ends[-1])) - np.repeat(ends - kept, kept) + np.repeat(first, kept)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(hashes[at]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], names=["id", "n", "d1", "d2", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_"))
    return mapped(rows, run, "id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id and the whole shingle set of the documents that ids names."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text_", most_rows=1 << _ROW_BITS):
                hashes, count = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "shingles"])

    few = ids.count() <= MOST_BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_"))
    return mapped(rows.join(F.broadcast(ids) if few else ids, "id", "left_semi"), run, "id long, shingles array<long>")


def estimate(a, b, k: int = K):
    """Column: the share of the union sketch of two sketches that both hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _candidates(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """Pairs (x, hub) whose sizes and union sketch allow a link, with the estimate."""
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    rows = pairs.join(side("x"), "x").join(side("hub"), "hub")
    rows = rows.where("100 * least(n_x, n_hub) >= 75 * greatest(n_x, n_hub)")
    return rows.select("x", "hub", estimate(F.col("sketch_x"), F.col("sketch_hub"), k).alias("likely")).where(F.col("likely") >= LEAST_ESTIMATE)


def _shared_counts(values: np.ndarray, width: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Of sets laid end to end: how many values each set outside and each other set share, in the order of the rows."""
    row = np.repeat(np.arange(len(width)), width)
    met, at = np.unique(values, return_inverse=True)
    place = np.where(outside, np.cumsum(outside), np.cumsum(~outside)) - 1
    mine = outside[row]
    both = (np.bincount(at[mine], minlength=len(met)) > 0) & (np.bincount(at[~mine], minlength=len(met)) > 0)
    slot = np.where(both, np.cumsum(both) - 1, -1)[at]
    order = np.argsort(slot, kind="stable")
    slot, row, mine = slot[order], row[order], mine[order]
    n_left = int(outside.sum())
    shared = np.zeros((n_left, len(width) - n_left), np.float32)
    for lo in range(0, int(both.sum()), BLOCK):
        here = slice(*np.searchsorted(slot, (lo, lo + BLOCK)))
        k, r, m = slot[here] - lo, row[here], mine[here]
        a, b = np.zeros((n_left, BLOCK), np.float32), np.zeros((shared.shape[1], BLOCK), np.float32)
        a[place[r[m]], k[m]] = 1
        b[place[r[~m]], k[~m]] = 1
        shared += a @ b.T
    return shared


def _block(table, column: str):
    """A block of a list's members outside its largest component (rows) and one of all its members (columns): places of both,
    components, ids, set sizes, shared values, and which pairs lie in different components (two members outside meet twice)."""
    outside, c, rep = (table.column(name).to_numpy() for name in ("outside", "c_rep", "rep"))
    lists = table.column(column).combine_chunks()
    width = lists.value_lengths().to_numpy().astype(np.int32)
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    shared = _shared_counts(lists.flatten().to_numpy(), width, outside)
    apart = (c[left][:, None] != c[right][None]) & ((c[right] == table.column("c_most")[0].as_py())[None] | (rep[left][:, None] < rep[right][None]))
    return left, right, c, rep, width, shared, apart


def _likeliest(table, most: int):
    """Pairs (x, hub) of different components that are likely links by their set sizes and sketches, and how many values they share: of
    each x the `most` that share the most."""
    import pyarrow as pa

    left, right, _, rep, width, shared, fits = _block(table, "sketch")
    n = table.column("n").to_numpy().astype(np.int32)
    n_a, n_b = n[left][:, None], n[right][None]
    fits &= (shared >= LIKELY * np.maximum(width[left][:, None], width[right][None])) & (100 * np.minimum(n_a, n_b) >= 75 * np.maximum(n_a, n_b))
    if most < len(right):
        best = np.argpartition(np.where(fits, -shared, 1), most - 1, axis=1)[:, :most]
        few = np.zeros_like(fits)
        np.put_along_axis(few, best, True, axis=1)
        fits &= few
    i, j = np.nonzero(fits)
    give_back()
    return pa.table({"x": pa.array(rep[left][i]), "hub": pa.array(rep[right][j]), "shared": pa.array(shared[i, j].astype(np.int32))})


def _set_links(table):
    """Links a, b of a spanning forest over the components of the members that a block's full sets link."""
    import pyarrow as pa

    left, right, c, rep, width, shared, fits = _block(table, "shingles")
    fits &= 100 * shared >= 75 * (width[left][:, None] + width[right][None] - shared)
    tree = np.unique(c, return_inverse=True)[1]  # of each row, the tree that its component is in so far
    a, b = [], []
    for k in np.flatnonzero(fits.any(axis=1)):
        hits = right[fits[k]]
        trees, first = np.unique(tree[hits], return_index=True)
        apart = trees != tree[left[k]]
        a += [rep[left[k]]] * int(apart.sum())
        b += rep[hits[first[apart]]].tolist()
        tree[np.isin(tree, trees)] = tree[left[k]]
    give_back()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _by_blocks(members: DataFrame, held: DataFrame, column: str, run, schema: str) -> DataFrame:
    """run for every block of a long list's members outside its largest component and block of all its members. members: v, rep,
    c_rep, and of the list c_most, its largest component, and the parts that its members and those outside are cut into. held: rep,
    n and the sets in `column`."""
    rows = members.join(held, "rep")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(c)).cast("int")
    what = ["v", "rep", "c_rep", "c_most", "n", column]
    left = rows.where("c_rep <> c_most").select(*what, F.lit(True).alias("outside"), one("parts_outside", 1).alias("i"), every("parts").alias("j"))
    right = rows.select(*what, F.lit(False).alias("outside"), every("parts_outside").alias("i"), one("parts", 2).alias("j"))
    ship(members.sparkSession)
    return left.unionByName(right).groupBy("v", "i", "j").applyInArrow(run, schema)


def _mixed(early: DataFrame) -> DataFrame:
    """Lists (v) whose members lie in several components: n_list, c_most, and the parts that its members and those outside its
    largest component are cut into."""
    counted = early.groupBy("v", "c_rep").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
    counted = counted.groupBy("v").agg(F.sum("n").alias("n_list"), F.sum("s").alias("s_list"), F.max(F.struct("n", (-F.col("c_rep")).alias("c"), "s")).alias("most")).where("n_list > most.n")
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    outside = parts(F.col("n_list") - F.col("most.n"), F.col("s_list") - F.col("most.s"))
    return counted.select("v", "n_list", (-F.col("most.c")).alias("c_most"), parts(F.col("n_list"), F.col("s_list")).alias("parts"), outside.alias("parts_outside"))


def _verified(pairs: DataFrame, docs: DataFrame, columns: dict) -> DataFrame:
    """Those pairs (x, hub) with 100 * intersection >= 75 * union on full sets, as links a, b."""
    ids = written(pairs.select(F.explode(F.array("x", "hub")).alias("id")).distinct(), "verify_ids")
    sets = written(full_sets(docs, ids, **columns), "verify_sets")
    side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}"))
    rows = pairs.select("x", "hub").join(side("x"), "x").join(side("hub"), "hub")
    both = F.size(F.array_intersect("set_x", "set_hub"))
    rows = rows.select("x", "hub", both.alias("both"), (F.size("set_x") + F.size("set_hub") - both).alias("either"))
    return rows.where("100 * both >= 75 * either").select(F.col("x").alias("a"), F.col("hub").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, short_list: int = SHORT_LIST) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), kept (whether the id is that one) for every row."""
    columns = {"id_col": id_col, "text_col": text_col}
    all_rows = written(sketches(docs, k=k, **columns), "sketches")
    known = all_rows.where("n > 0 and id is not null")
    classes = known.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.any_value("sketch").alias("sketch"))
    reps = written(classes, "classes")

    lists = reps.select("rep", "n", F.size("sketch").alias("width"), F.explode("sketch").alias("v"))
    shared = written(lists.groupBy("v").agg(F.count("*").alias("size")).where("size > 1"), "shared_values")
    own = Window.partitionBy("rep")  # at most k rows
    alone = F.col("width") - F.count("*").over(own)  # values that no other sketch holds come first
    lists = lists.join(shared, "v").withColumn("fame", F.sum("size").over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", "v")) + alone)
    lists = written(lists, "lists")
    hubs = written(lists.groupBy("v").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("h1"), F.min_by("rep", F.xxhash64("v", "rep")).alias("h2")), "hubs")
    pairs = lists.join(hubs, "v").select(F.col("rep").alias("x"), F.explode(F.array("h1", "h2")).alias("hub")).where("x <> hub").distinct()
    first = written(_candidates(pairs, reps, k), "hub_pairs")
    best = first.groupBy("x").agg(F.max_by("hub", F.struct("likely", -F.col("hub"))).alias("hub"))
    # rows of one id under several texts are one node
    again = known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    again = known.join(again, "id").join(reps.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = written(_verified(written(best, "best_pairs"), docs, columns).union(again), "links1")
    parts = written(components(links), "components1")

    of = lambda rows, c: rows.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")), c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))

    def joined(more: DataFrame) -> DataFrame:
        """parts with further links: only what they change goes through components again."""
        over = of(of(more.select("a", "b"), "a"), "b").where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        moved = components(over).select(F.col("id").alias("component"), F.col("component").alias("to"))
        known = parts.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        alone = moved.select(F.col("component").alias("id"), F.col("to").alias("component")).join(parts, "id", "left_anti")
        return written(known.unionByName(alone), "components2")

    rest = of(of(first.select("x", "hub"), "x"), "hub").where("c_x <> c_hub").select("x", "hub")
    least = F.when(F.col("width") >= k, F.lit(LEAST_SHARED * k // K)).otherwise(F.ceil(F.col("width") / 2))
    early = written(of(lists.where(F.col("rank") <= F.col("width") - least + 1).select("v", "rep", "n"), "rep"), "early_lists")
    mixed = written(_mixed(early), "mixed_lists")
    members = early.join(mixed.where(F.col("n_list") <= short_list).select("v"), "v").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c_rep", "rep"))).alias("m"))
    apart = F.expr("explode(flatten(transform(m, (p, i) -> transform(filter(slice(m, i + 2, size(m)), q -> q.c_rep <> p.c_rep), q -> struct(p.rep as x, q.rep as hub)))))")
    cross = members.select(apart.alias("p")).select("p.x", "p.hub")
    long_ = written(early.join(mixed.where(F.col("n_list") > short_list), "v").drop("n"), "long_lists")
    likely = _by_blocks(long_, reps.select("rep", "n", "sketch"), "sketch", lambda t: _likeliest(t, AT_FIRST), "x long, hub long, shared int").distinct()
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "hub"))  # ranks are limited before the shuffle too
    cross = cross.union(likely.withColumn("place", best).where(F.col("place") <= AT_FIRST).select("x", "hub"))
    cross = cross.select(F.least("x", "hub").alias("x"), F.greatest("x", "hub").alias("hub")).distinct()
    second = written(_candidates(written(cross, "met_pairs"), reps, k).select("x", "hub").union(rest).distinct(), "cross_pairs")
    parts = joined(_verified(second, docs, columns))

    early = written(of(early.join(long_.select("v").distinct(), "v").select("v", "rep", "n"), "rep"), "early_lists")
    long_ = written(early.join(written(_mixed(early), "mixed_lists"), "v").drop("n"), "long_lists")
    ids = written(long_.select(F.col("rep").alias("id")).distinct(), "verify_ids")
    sets = written(full_sets(docs, ids, **columns).select(F.col("id").alias("rep"), F.size("shingles").cast("long").alias("n"), "shingles"), "verify_sets")
    parts = joined(written(_by_blocks(long_, sets, "shingles", _set_links, "a long, b long"), "set_links"))

    labelled = reps.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("id", "n", "d1", "d2").join(labelled, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

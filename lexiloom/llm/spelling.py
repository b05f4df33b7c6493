"""Operator 11: words that are spelling variants of commoner ones, from dictionaries sorted forward and reversed.

Two near words (one code point inserted, deleted or replaced) share their first half or their last half. So every word stands in a
forward dictionary under its first code points and in a reversed one under its last ones, once with words of its own length and once with those one
shorter (m is the shorter length of a pair); words under one entry lie next to each other in the sorted dictionary, and a scan of its ranges
compares them. Entries of more than MOST words are subdivided: their words move to longer entries, and pairs that part just within the step
meet under what is left of them without the code point at which they part: an entry with one word for each letter at most. Every pair thus meets
under exactly one entry of one dictionary, whatever the skew, and no list of pairs is made: a range sends a word's count of near words and the best of them.

Forms are followed to their roots by doubling: each round joins the words that are on their way with the form of their form.

Defined results: null texts hold nothing; a null id reads as empty in the hash that deletes code points; rows alike in id and text count each. Extra columns are
ignored, whatever their names. Without words there are no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, written

#: Maximal runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Every hash that this divides loses a code point.
SLIP = 97
#: Words of a dictionary's entry; larger ones are subdivided.
MOST = 64
#: Ids of large entries up to this number are broadcast; beyond it they are joined by shuffle.
MOST_BROADCAST = 100_000
#: Words up to this length are compared in arrays, longer ones one by one.
WIDE = 48
#: Pairs compared at a time.
PAIRS = 1 << 17

_KEY = ["side", "entry", "m", "gap", "depth"]


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the words of all texts and how often they occur."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), upper, upper.lower()), F.lit(LETTERS), F.lit(0))
    words = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(runs).alias("run"))
    words = words.where(F.char_length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = words.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _least(m, side: str):
    """How much of words the shorter of which has m code points an entry holds at least: together one less than what one edit leaves whole."""
    half = F.floor(m / 2).cast("int")
    return half if side == "forward" else m - half


def _entries(words: DataFrame, least_length: int) -> DataFrame:
    """Every word under its entries: side, entry, m, gap (whether a code point is left out), depth (of the entry, or of the gap), word, n."""
    size = F.char_length("word")
    rows = words.withColumn("m", F.explode(F.when(size > least_length, F.array(size - 1, size)).otherwise(F.array(size))))
    sides = []
    for side in ("forward", "reversed"):
        depth = _least(F.col("m"), side)
        own = F.col("word") if side == "forward" else F.reverse("word")
        sides.append(rows.select(F.lit(side).alias("side"), F.substring(own, F.lit(1), depth).alias("entry"), "m", F.lit("").alias("gap"), depth.alias("depth"), "word", "n"))
    return sides[0].unionByName(sides[1])


def _subdivided(rows: DataFrame, most: int) -> DataFrame:
    """Entries of at most `most` words, but for those that no letter more can part."""
    step, done = 1, []
    while True:
        rows = written(rows, "entries")
        large = written(rows.groupBy(*_KEY).count().where((F.col("count") > most) & (F.col("depth") < F.col("m"))).select(*_KEY), "large_entries")
        few = large.count()
        if not few:
            break
        large = F.broadcast(large) if few <= MOST_BROADCAST else large
        done.append(rows.join(large, _KEY, "left_anti"))
        hot = rows.join(large, _KEY, "left_semi").withColumn("own", F.when(F.col("side") == "forward", F.col("word")).otherwise(F.reverse("word")))
        deep = F.least(F.col("depth") + step, F.col("m"))
        rest = F.char_length("own")
        hot = hot.withColumn("deep", deep)
        longer = hot.select("side", F.substring("own", F.lit(1), F.col("deep")).alias("entry"), "m", "gap", F.col("deep").alias("depth"), "word", "n")
        # pairs that part at a place before the new depth: alike but for that code point, or that one more
        at = hot.withColumn("place", F.explode(F.sequence(F.col("depth"), F.col("deep") - 1)))
        head = F.substring("own", F.lit(1), F.col("place"))
        out = F.concat(head, F.lit("-"), F.substring("own", F.col("place") + 2, rest))
        whole = F.concat(head, F.lit("-"), F.substring("own", F.col("place") + 1, rest))
        kinds = F.when(rest == F.col("m"), F.array(F.struct(F.lit("replaced").alias("gap"), out.alias("entry")), F.struct(F.lit("inserted").alias("gap"), whole.alias("entry")))).otherwise(F.array(F.struct(F.lit("inserted").alias("gap"), out.alias("entry"))))
        parted = at.select("side", "m", F.col("place").alias("depth"), "word", "n", F.explode(kinds).alias("kind"))
        done.append(written(parted.select("side", "kind.entry", "m", "kind.gap", "depth", "word", "n"), "parted_entries"))
        rows, step = longer, 2 * step
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _shared(words: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common beginnings and endings of pairs of words (rows of code points, padded with 0)."""
    ends = []
    for flip in (False, True):
        table = words
        if flip:
            at = size[:, None] - 1 - np.arange(words.shape[1])
            table = np.where(at >= 0, np.take_along_axis(words, np.clip(at, 0, words.shape[1] - 1), axis=1), 0)
        apart = table[a] != table[b]
        first = np.where(apart.any(axis=1), apart.argmax(axis=1), words.shape[1])
        ends.append(np.minimum(first, np.minimum(size[a], size[b])))
    return ends[0], ends[1]


def _one_by_one(texts: list[str], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for words of any length."""
    import os

    both = [(len(os.path.commonprefix([texts[i], texts[j]])), len(os.path.commonprefix([texts[i][::-1], texts[j][::-1]]))) for i, j in zip(a.tolist(), b.tolist())]
    p, s = zip(*both) if both else ((), ())
    return np.array(p, np.int64), np.array(s, np.int64)


def _compared(texts: list[str], n: np.ndarray, block: np.ndarray, forward: np.ndarray, gap: np.ndarray, m: np.ndarray, depth: np.ndarray):
    """Near pairs among rows of equal block (blocks follow each other): both ends of each."""
    size = np.array([len(t) for t in texts])
    wide = min(WIDE, int(size.max(initial=1)))
    words = np.frombuffer("".join(t[:wide].ljust(wide, "\0") for t in texts).encode("latin-1"), np.uint8).reshape(-1, wide)
    ends = np.searchsorted(block, block, side="right")
    after = ends - np.arange(len(texts)) - 1
    lo = 0
    upto = np.cumsum(after)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(lo, hi), after[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[lo:hi] - after[lo:hi] - (upto[lo - 1] if lo else 0), after[lo:hi])
        lo = hi
        short, long_ = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fits = (short == m[a]) & (long_ <= short + 1)
        a, b = a[fits], b[fits]
        small = np.maximum(size[a], size[b]) <= wide
        p, s = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        p[small], s[small] = _shared(words, size, a[small], b[small])
        if not small.all():
            p[~small], s[~small] = _one_by_one(texts, a[~small], b[~small])
        same = size[a] == size[b]
        near = p + s >= np.where(same, m[a] - 1, m[a])
        # each pair counts under one entry: the forward one if half is shared there, at its own depth
        own = np.where(forward[a], p, s)
        near &= np.where(forward[a], True, p < m[a] // 2) & np.where(gap[a], own == depth[a], own >= depth[a])
        yield np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]])


def _scanned(batches):
    """Ranges of the sorted dictionaries: word, near (how many near words), best (the commonest of them), best_n."""
    import pyarrow as pa

    def near(table):
        texts = table.column("word").to_pylist()
        n = table.column("n").to_numpy()
        keys = [table.column(c).to_pylist() for c in _KEY]
        block = np.zeros(len(texts), np.int64)
        if len(texts):
            rows = list(zip(*keys))
            block[1:] = np.cumsum([x != y for x, y in zip(rows[1:], rows)])
        forward = np.array([x == "forward" for x in keys[0]], bool)
        gap = np.array([x != "" for x in keys[3]], bool)
        m, depth = np.array(keys[2], np.int64), np.array(keys[4], np.int64)
        rank = np.unique(np.array(texts, dtype=object), return_inverse=True)[1] if texts else np.zeros(0, np.int64)
        for a, b in _compared(texts, n, block, forward, gap, m, depth):
            order = np.lexsort((rank[b], -n[b], a))
            who, first, count = np.unique(a[order], return_index=True, return_counts=True)
            best = b[order][first]
            yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in who.tolist()], pa.string()), pa.array(count.astype(np.int64)), pa.array([texts[i] for i in best.tolist()], pa.string()), pa.array(n[best].astype(np.int64))], names=["word", "near", "best", "best_n"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = [table.column(c)[-1] for c in _KEY] if table.num_rows else None
        cut = table.num_rows  # the last entry may go on in the next batch
        while cut and [table.column(c)[cut - 1] for c in _KEY] == last:
            cut -= 1
        yield from near(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield from near(held.combine_chunks())


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """word, n_near, form_n, form (the commonest near word) of words (word, n) that have near ones."""
    rows = _subdivided(_entries(words, least_length), most)
    ranges = rows.select(*_KEY, "word", "n").repartitionByRange("side", "entry").sortWithinPartitions(*_KEY)
    found = mapped(ranges, _scanned, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.less")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, both not null and without cycles. word, root: where the forms of each word end. A round doubles the steps;
    words that have arrived are no longer joined, so that no root's words meet in one task."""
    up = forms.select(F.col("word").alias("form"), F.lit(True).alias("more"))
    now = written(forms.join(up, "form", "left").select("word", F.col("form").alias("at"), F.col("more").isNull().alias("there")), "roots")
    while not now.where("not there").isEmpty():
        above = now.select(F.col("word").alias("at"), F.col("at").alias("above"), F.col("there").alias("arrived"))
        gone = now.where("not there").join(above, "at").select("word", F.col("above").alias("at"), F.col("arrived").alias("there"))
        now = written(now.where("there").unionByName(gone), "roots")
    return now.select("word", F.col("at").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root for every word."""
    words = written(counted_words(docs, id_col, text_col), "spelling_words")
    near = near_words(words)
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= 2 * F.col("n"), F.struct("best", "best_n")).alias("x"))
    out = written(out.select("word", "n", "n_near", F.col("x.best").alias("form"), F.col("x.best_n").alias("form_n")), "spelling_forms")
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Operator 8: document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's 5-word shingles are hashed once. The top bits of a hash name its bin, and each bin keeps its smallest hash: sorting the
hashes puts the bins next to each other, so the kept ones are those whose predecessor lies in another bin. An empty bin takes
over the value of another (optimal densification): every bin walks all bins in an order of its own, bin -> (a * step + b) mod BINS
with a and b drawn for the bin, and takes the first that is filled. Of each bin LOW_BITS low-order bits are packed as two hex
digits. Likeness is the share m of equal bins, corrected for chance equality: (m - 2^-8) / (1 - 2^-8), at least 0.

Defined results: a text with fewer words than a shingle has one shingle of them all; a text without words (null, empty, white
space) has an empty fingerprint, like only to an empty one (1.0; else 0.0). Equal texts have equal fingerprints. Documents are
ordered by id, then by SHA-256 of the text, so ties are settled and rows alike in both are one document that gets its result once per row;
a null id comes last in descending order. Other columns are ignored, whatever their names.

The next document is found without one task holding the table: ids are dealt to ranges in order and written, each range finds
its rows' neighbours, and only the first row of each range (PARTS of them) is matched across. Texts are shuffled once by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WIDTH = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
#: Ranges that ids are dealt to at least; one row of each meets in one task.
PARTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _walk(bin_: int) -> tuple[int, int]:
    """The numbers a (inverse, odd) and b of a bin's walk over all bins."""
    h = (bin_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return h >> 40 & BINS - 1 | 1, h >> 20 & BINS - 1


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with column `out`: the fingerprint of column `text`."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), "[ \\t-\\r]+"), lambda w: w != "")
    rows = rows.withColumn("words_", words)
    at = ", ".join(f"words_[i + {k}]" for k in range(WIDTH))
    hashes = F.expr(f"case when size(words_) >= {WIDTH} then transform(sequence(0, size(words_) - {WIDTH}), i -> xxhash64({at})) when size(words_) > 0 then array(xxhash64(array_join(words_, ' '))) else cast(array() as array<bigint>) end")
    rows = rows.withColumn("hashes_", F.sort_array(hashes)).drop("words_")
    # the first hash of each bin; sorted as signed numbers, bins still lie together
    firsts = F.expr(f"filter(hashes_, (h, i) -> i = 0 or shiftright(h, {64 - BIN_BITS}) <> shiftright(hashes_[i - 1], {64 - BIN_BITS}))")
    rows = rows.withColumn("firsts_", firsts).drop("hashes_")
    half = BINS // 2
    walks = "array(" + ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in map(_walk, range(BINS))) + ")"
    # for bin w: the filled bin that its walk meets first, as the least (step * 2^32 + place among the filled)
    filled = f"transform(firsts_, h -> cast(shiftright(h, {64 - BIN_BITS}) as int) + {half})"
    rows = rows.withColumn("filled_", F.when(F.size("firsts_") < BINS, F.expr(filled)))
    dense = f"transform({walks}, (w, k) -> case when array_contains(filled_, k) then element_at(firsts_, cast(array_position(filled_, k) as int)) else element_at(firsts_, cast(array_min(transform(filled_, (f, j) -> ((((f - w.b + {BINS}) * w.a) % {BINS}) * 1024 + j + 1))) % 1024 as int)) end)"
    rows = rows.withColumn("bins_", F.when(F.col("filled_").isNull(), F.col("firsts_")).when(F.size("firsts_") > 0, F.expr(dense)).otherwise(F.col("firsts_"))).drop("firsts_", "filled_")
    packed = F.array_join(F.transform("bins_", lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))), 2, "0")), "")
    return rows.withColumn(out, packed).drop("bins_")


def likeness(a: str, b: str) -> Column:
    """Column: likeness of two fingerprint columns."""
    equal = F.expr(f"size(filter(sequence(0, {BINS - 1}), i -> substring({a}, 2 * i + 1, 2) = substring({b}, 2 * i + 1, 2)))")
    chance = 2.0**-LOW_BITS
    share = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(share)


def next_keys(keys: DataFrame, order: list[Column]) -> DataFrame:
    """keys: distinct k and the columns of order. Returns k and next_k, the next key in the order, the first one after the last."""
    parts = max(PARTS, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "fingerprint_keys")
    own = Window.partitionBy("part").orderBy(*order)
    within = placed.withColumn("next_k", F.lead("k").over(own)).withColumn("place", F.row_number().over(own))
    line = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a range
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = within.where("place = 1").select("part", F.coalesce(F.lead("k").over(line), F.first("k").over(everything)).alias("after"))
    return within.join(F.broadcast(heads), "part").select("k", F.coalesce("next_k", "after").alias("next_k"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = rows.select(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), sha).alias("k"), "text")
    of_id = F.split("k", ":")[0]
    keys = rows.groupBy("k", F.floor(F.char_length("text") / 2).cast("int").alias("half")).agg(F.count("*").alias("copies"))
    keys = written(keys.withColumn("id", F.when(of_id != "", of_id.cast("long"))), "fingerprint_rows")
    after = written(next_keys(keys.select("k", "id"), [F.col("id").desc_nulls_last(), F.col("k").desc()]).join(keys.select("k", "half"), "k"), "fingerprint_next")

    # both uses of the texts need the same columns, so that one shuffle serves them
    texts = with_fingerprint(rows, "text", "fingerprint")
    wanted = after.select(F.col("next_k").alias("k"), F.col("k").alias("before"), "half")
    starts = texts.join(wanted, "k").select(F.col("before").alias("k"), F.expr("substring(text, 1, half)").alias("start"), F.col("fingerprint").alias("next_fingerprint"))
    if not keys.where("copies > 1").isEmpty():
        starts = starts.dropDuplicates(["k"])
    n = F.char_length("text")
    kept = n - F.floor(n / 2).cast("int")
    out = texts.join(starts, "k").withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "start")).withColumn("n_chars", n.cast("long")).drop("start", "text")
    out = out.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    out = with_fingerprint(out, "edited", "edited_fingerprint").drop("edited")
    return out.select(
        F.when(of_id != "", of_id.cast("long")).cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )

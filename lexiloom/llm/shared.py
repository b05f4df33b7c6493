"""What the training-data operators share: the shared folder, and Arrow and byte helpers that run inside tasks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: ASCII white space of the word contracts: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _MULT, dtype=np.uint64)]), dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local run makes a temporary
    folder and sets it once for the session; a cluster has no such folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, and losing an executor loses nothing."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow, with this package sent to the workers first, wherever the driver runs from."""
    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def crc32_of_id(column: str):
    """crc32 of the id written as text, as the fold rules of the queries want it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(batch, column: str = "text", most_bytes: int = 1 << 20, most_rows: int = 4096):
    """Slices of an Arrow batch that hold about most_bytes of text and at most most_rows rows each (a longer text makes a
    slice of its own), so that numpy's working arrays stay small whatever the batch holds. Yields (slice, bytes as uint8,
    offsets); null reads as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = batch.schema.get_field_index(column)
    whole = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    n = len(whole)
    if not n:
        return
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=whole.offset + n + 1)[whole.offset :]
    raw = whole.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1)
        hi = min(hi, n, lo + most_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def joined_chunks(texts: list[str | None], most_bytes: int = 1 << 20):
    """Texts laid end to end in chunks, for the driver's fits: (place of the first, bytes as uint8, offsets)."""
    lo, raw, size = 0, [], 0
    for k, t in enumerate([*texts, None]):
        b = (t or "").encode("utf-8", "surrogatepass")
        if raw and (k == len(texts) or size + len(b) > most_bytes):
            yield lo, np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            lo, raw, size = k, [], 0
        raw.append(b)
        size += len(b)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers outlive their tasks and the driver its fits, and
    would keep it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Words (maximal runs without white space, never across texts) of concatenated texts: starts, ends, and the text each lies in."""
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    solid = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    prev = np.empty(n, dtype=bool)
    prev[0], prev[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~prev | first[:n]))
    follow = np.empty(n, dtype=bool)
    follow[-1], follow[:-1] = True, ~solid[1:] | first[1:n]
    ends = np.flatnonzero(solid & follow) + 1
    count = np.diff(np.searchsorted(starts, offsets))  # a text's words begin in it
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), count)


#: What a byte adds to its word's hash, before its place is told: nothing for white space; as it is, and lower-cased.
_ADDS = [np.where(SPACE, np.uint64(0), mix((case.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))) for case in (np.arange(256, dtype=np.uint8), LOWER)]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """The words of concatenated texts (word_spans), and a 64-bit hash of each word's bytes."""
    starts, ends, doc = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, doc, np.zeros(0, np.uint64)
    low = int(starts[0])
    within = np.arange(low, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))  # white space behind a word counts on and adds nothing
    size = ends - starts
    if int(within.max()) < len(_POWERS):
        power = _POWERS[within]
    else:
        power = _POWERS[within % len(_POWERS)]
        wide = np.flatnonzero(within >= len(_POWERS))  # words beyond 4096 bytes: fold the block number in
        power[wide] = mix(power[wide] + (within[wide] // len(_POWERS)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    power *= _ADDS[bool(lower)][data[low:]]
    h = np.add.reduceat(power, starts - low)
    return starts, ends, doc, mix(h + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5):
    """64-bit hashes of the word shingles of each text, with repeats, and the text of each: runs of width words, or of all
    words where a text has fewer."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    odd = [np.uint64(x) for x in mix(np.arange(1, width + 1, dtype=np.uint64) * _MULT) | np.uint64(1)]
    m = len(h)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        total[: m - k] += h[k:] * odd[k]
    full = np.arange(m) + width <= first[doc] + count[doc] if m else np.zeros(0, bool)
    out, out_doc = [mix(total[full])], [doc[full]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        part = h[first[d] : first[d] + count[d]]
        acc = np.uint64(0)
        with np.errstate(over="ignore"):
            for k in range(len(part)):
                acc = acc + part[k] * odd[k]
            acc = acc + np.uint64(count[d]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(mix(np.array([acc], dtype=np.uint64)))
        out_doc.append(np.array([d]))
    return np.concatenate(out), np.concatenate(out_doc)

"""Operator 1: exact token counts at every prefix of a text, by prefix dynamic programming.

For each segment of a text a table holds the token count of every prefix: the encoding of a prefix is the encoding of a
shorter one plus the one last token that stays whole behind it, so count[end] = count[end - len(last)] + width(last). Segments
are independent, so the count of any prefix of a text is the sum over the segments before it plus one table entry. Truncation
and budget questions are look-ups; nothing is encoded again.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows give repeated rows; columns besides
the id and the text are ignored, whatever their names. Memory: a worker keeps at most MOST_TABLES tables and rebuilds any other.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_bpe import PieceBpe, segments, vocabulary
from .shared import mapped

#: Tables of segments that a worker keeps; a full store is emptied and filled anew.
MOST_TABLES = 600_000
#: Longer segments are tabulated each time, not kept.
LONGEST_KEPT = 60


class PrefixTables(dict):
    """segment -> token counts of its prefixes, as bytes (a kept segment has at most 4 * LONGEST_KEPT tokens)."""

    def __init__(self, vocab: PieceBpe):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, segment: str):
        counts = self.vocab.prefix_counts(segment)
        if len(segment) > LONGEST_KEPT:
            return counts
        if len(self) >= MOST_TABLES:
            self.clear()
        self[segment] = table = bytes(counts)
        return table


_tables: dict[str, PrefixTables] = {}


def tables(path: str) -> PrefixTables:
    if path not in _tables:
        _tables[path] = PrefixTables(vocabulary(path))
    return _tables[path]


def count_and_cut(text: str | None, store: PrefixTables, limit: int) -> tuple[int, int]:
    """Token count of a text, and the length in characters of its longest prefix of at most limit tokens."""
    segs = segments(text)
    if not segs:
        return 0, 0
    rows = list(map(store.__getitem__, segs))
    total = np.cumsum(np.fromiter((r[-1] for r in rows), dtype=np.int64, count=len(rows)))
    if total[-1] <= limit:
        return int(total[-1]), len(text)
    k = bisect_right(total, limit)
    base = int(total[k - 1]) if k else 0
    fits = max(i for i, c in enumerate(rows[k]) if base + c <= limit)
    return int(total[-1]), max(0, sum(map(len, segs[:k])) + fits - 1)  # the first blank is the normalizer's


def prefix_counts(text: str | None, store: PrefixTables) -> np.ndarray:
    """Token count of every prefix of a text: entry i is that of its first i characters."""
    if not text:
        return np.zeros(1, dtype=np.int32)
    parts, base = [], 0
    for seg in segments(text):
        row = np.fromiter(store[seg], dtype=np.int32)
        parts.append(row[1:] + base)
        base += int(row[-1])
    out = np.concatenate(parts)
    out[0] = 0  # behind the blank alone stands the empty prefix
    return out


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, limit_chars (characters of the longest prefix within the limit)."""

    def run(batches):
        import pyarrow as pa

        store = tables(vocabulary_path)
        for batch in batches:
            got = [count_and_cut(t, store, limit) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([n for n, _ in got], pa.int64()), pa.array([n > limit for n, _ in got], pa.bool_()), pa.array([c for _, c in got], pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text_"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes_"))
    return mapped(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_table(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and prefix_tokens: the token count of every prefix of the text, empty prefix first."""

    def run(batches):
        import pyarrow as pa

        store = tables(vocabulary_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = pa.array([prefix_counts(t, store) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=[id_col, "prefix_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, F.col(text_col).alias("text_")), run, f"`{id_col}` {kind}, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens, n_chars):
    """Column: token count of the first n_chars characters, from a stored prefix table."""
    return F.get(prefix_tokens, F.least(n_chars, F.size(prefix_tokens) - 1))


def prefix_within(prefix_tokens, budget: int):
    """Column: characters of the longest prefix of at most budget tokens, from a stored prefix table."""
    fits = F.filter(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return F.array_max(fits)

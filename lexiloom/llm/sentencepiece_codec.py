"""Operator 3: SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are laid end to end and indexed with a suffix array over their first characters, as
many as the longest piece has. Every piece of the vocabulary is binary-searched at once for the range of suffixes that begin
with it; the ranges are the lattice's edges. Sorted by end position, longest first, they are relaxed left to right: a position
takes the one edge whose piece stays whole behind the piece that its start position took. That is exact for piece BPE, whose
ids the public library gives. A text's ids are those of its segments, one after another.

Defined results: null encodes as empty; an empty text has no ids; a character outside the vocabulary becomes its UTF-8 byte
pieces; decoding gives back the text that was encoded (a blank mark in it as the blank that it stands for), and U+FFFD for ids whose bytes are no UTF-8. Repeated rows give repeated
rows. Memory: texts pass in slices of about 1 MB, a worker keeps at most MOST_KEPT segments.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from .piece_bpe import PieceBpe, segments, vocabulary
from .shared import give_back, mapped

MOST_KEPT = 400_000
LONGEST_KEPT = 60
#: Pairs of neighbouring tokens whose answer a worker keeps.
MOST_PAIRS = 2_000_000
#: Characters of text taken together; and of distinct segments indexed together.
SLICE_CHARS = 1 << 20
INDEX_CHARS = 1 << 19
#: Code points that fit in one number, and the largest that it takes for one.
HEAD, MOST_CODE = 3, (1 << 21) - 1


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of an array of code points, ordered by their first `depth` characters (prefix doubling)."""
    _, rank = np.unique(chars, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width, order = 1, np.argsort(rank, kind="stable")
    bits = len(chars).bit_length()
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        key = rank * (int(rank.max()) + 1) + after
        if int(key.max()).bit_length() + bits <= 63:  # key and place in one number sort much faster
            packed = np.sort((key << bits) | np.arange(len(key)))
            order = packed & ((1 << bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        width *= 2
    return order


def packed(codes: np.ndarray) -> np.ndarray:
    """Rows of HEAD code points as numbers in the same order."""
    out = codes[:, 0].astype(np.int64)
    for k in range(1, HEAD):
        out = out << 21 | codes[:, k]
    return out


class Matcher:
    """Finds every occurrence of every piece in indexed text."""

    def __init__(self, vocab: PieceBpe):
        self.vocab = vocab
        keep = [(p, i) for p, i in vocab.ids.items() if len(p) > 1 and vocab.stable(p)]
        self.depth = vocab.longest
        self.names = [p for p, _ in keep]
        self.sizes = np.array([len(p) for p, _ in keep])
        self.ids = np.array([i for _, i in keep])
        self.pairs, self.answers = np.zeros(0, np.int64), np.zeros(0, bool)
        self.codes = np.zeros((len(keep), self.depth), dtype=np.uint32)
        for k, (p, _) in enumerate(keep):
            self.codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)
        head = np.zeros((len(keep), HEAD), np.uint32)
        head[:, : self.depth] = self.codes[:, :HEAD]
        self.least = packed(head)
        head[np.arange(HEAD) >= self.sizes[:, None]] = MOST_CODE
        self.most = packed(head)

    def _bound(self, chars: np.ndarray, order: np.ndarray, heads: np.ndarray, after: bool) -> np.ndarray:
        """For every piece, the first suffix not below it (after: the first beyond all that begin with it). heads, the suffixes' first
        characters, leave only longer pieces to be searched, among the suffixes that begin as they do."""
        low, high = np.searchsorted(heads, self.least), np.searchsorted(heads, self.most, side="right")
        short = self.sizes <= HEAD
        if after:
            low[short] = high[short]
        else:
            high[short] = low[short]
        reach = np.arange(self.depth)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            have = chars[order[mid][:, None] + reach]
            want = self.codes[open_]
            inside = reach < self.sizes[open_, None]
            unlike = (have != want) & inside
            at = unlike.argmax(axis=1)
            some = unlike[np.arange(len(at)), at]
            rows = np.arange(len(at))
            below = np.where(some, have[rows, at] < want[rows, at], after)
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        return low

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, piece) of every occurrence, by end, longest first. chars must end with depth zeros."""
        order = suffix_array(chars, self.depth)
        order = order[order < len(chars) - self.depth]
        heads = packed(chars[order[:, None] + np.arange(HEAD)])
        first, last = self._bound(chars, order, heads, False), self._bound(chars, order, heads, True)
        count = last - first
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        within = np.arange(len(piece), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        start = order.astype(np.int32)[np.repeat(first.astype(np.int32), count) + within]
        end = start + self.sizes.astype(np.int32)[piece]
        by = np.argsort(end.astype(np.int64) * 64 + (63 - np.minimum(self.sizes[piece], 63)), kind="stable")
        return end[by], start[by], piece[by]

    def _stays(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece stays whole behind the token before it; answers are kept, sorted by pair."""
        key = before * len(self.names) + piece
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        if not known.all():
            fresh = np.unique(key[~known])
            left, right = np.divmod(fresh, len(self.names))
            text = lambda t: self.names[t] if t < len(self.names) else chr(t - len(self.names))
            apart = lambda a, b: self.vocab.merge(a + b) == [a, b]  # noqa: E731  kept here alone, not in the vocabulary's own store
            said = np.fromiter((apart(text(x), self.names[y]) for x, y in zip(left.tolist(), right.tolist())), dtype=bool, count=len(fresh))
            if len(self.pairs) > MOST_PAIRS:  # only what this call needs is kept
                fresh, back = np.unique(np.concatenate([fresh, key[known]]), return_index=True)
                said = np.concatenate([said, self.answers[at[known]]])[back]
                self.pairs, self.answers = fresh, said
            else:
                order = np.argsort(pairs := np.concatenate([self.pairs, fresh]), kind="stable")
                self.pairs, self.answers = pairs[order], np.concatenate([self.answers, said])[order]
            at = np.searchsorted(self.pairs, key)
        return self.answers[at]

    def encode(self, distinct: list[str]) -> list[bytes]:
        """The ids of each segment as little-endian uint16. All segments are relaxed together, one position after another."""
        joined = "\0".join(distinct) + "\0" * (self.depth + 1)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(s) for s in distinct])
        begin = np.cumsum(size + 1) - size - 1
        inside = np.arange(len(chars)) - np.repeat(np.append(begin, begin[-1] + size[-1] + 1), np.append(size + 1, len(chars) - size.sum() - len(size)))
        multi = len(self.names)
        state = np.zeros(len(chars) + 1, dtype=np.int64)  # the last token of what ends here: a piece, or a character
        state[1:] = chars.astype(np.int64) + multi
        settled = np.zeros(len(chars) + 1, dtype=bool)
        end, start, piece = self.edges(chars)
        depth = end - start + inside[start]  # position of the end within its segment
        place = np.arange(len(end), dtype=np.int32)
        turn = place - np.maximum.accumulate(np.where(np.concatenate([[True], end[1:] != end[:-1]]), place, 0)) if len(end) else end
        by = np.lexsort((turn, depth))
        step = np.concatenate([[0], np.flatnonzero((depth[by][1:] != depth[by][:-1]) | (turn[by][1:] != turn[by][:-1])) + 1, [len(by)]])
        for lo, hi in zip(step[:-1].tolist(), step[1:].tolist()):
            e = by[lo:hi]
            e = e[~settled[end[e]]]
            if len(e):
                s = start[e]
                whole = inside[s] == 0
                deep = np.flatnonzero(~whole)
                if len(deep):
                    whole[deep] = self._stays(state[s[deep]], piece[e[deep]])
                e = e[whole]
                state[end[e]] = piece[e]
                settled[end[e]] = True
        took = np.append(self.sizes, 1)
        at, who, tokens, owners = begin + size, np.arange(len(distinct)), [], []
        while len(who):
            token = state[at]
            tokens.append(token)
            owners.append(who)
            at = at - took[np.minimum(token, multi)]
            more = at > begin[who]
            at, who = at[more], who[more]
        token, owner = np.concatenate(tokens[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owner, kind="stable")
        token, owner = token[order], owner[order]
        single = np.unique(token[token >= multi])
        spelled = [self.vocab.token_ids(chr(c - multi)) for c in single.tolist()]
        ids, width = np.empty(len(token), dtype=np.int64), np.ones(len(token), dtype=np.int64)
        plain = token < multi
        ids[plain] = self.ids[token[plain]]
        which = np.searchsorted(single, token[~plain])
        if len(which):
            ids[~plain] = np.array([x[0] for x in spelled])[which]
            width[~plain] = np.array([len(x) for x in spelled])[which]
        flat = np.repeat(ids, width)
        if (width > 1).any():  # characters spelled as bytes
            first = np.cumsum(width) - width
            wide = np.flatnonzero(~plain)[np.array([len(x) for x in spelled])[which] > 1]
            for k, w in zip(wide.tolist(), np.searchsorted(single, token[wide]).tolist()):
                flat[first[k] : first[k] + width[k]] = spelled[w]
        ends = np.cumsum(np.bincount(owner, weights=width, minlength=len(distinct)).astype(np.int64))
        raw = flat.astype("<u2").tobytes()
        return [raw[2 * a : 2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


_matchers: dict[str, Matcher] = {}
_kept: dict[str, dict[str, bytes]] = {}


def encode_slice(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text; what the kept segments lack is indexed and relaxed together."""
    if path not in _matchers:
        _matchers[path], _kept[path] = Matcher(vocabulary(path)), {}
    kept = _kept[path]
    split = [segments(t) for t in texts]
    need = list(set(chain.from_iterable(split)).difference(kept))
    fresh: dict[str, bytes] = {}
    lo = 0
    while lo < len(need):
        hi, total = lo, 0
        while hi < len(need) and (hi == lo or total + len(need[hi]) < INDEX_CHARS):
            total += len(need[hi]) + 1
            hi += 1
        fresh.update(zip(need[lo:hi], _matchers[path].encode(need[lo:hi])))
        lo = hi
    full = len(kept) + len(fresh) > MOST_KEPT
    kept.update(fresh)
    out = [np.frombuffer(b"".join(map(kept.__getitem__, segs)), dtype="<u2").astype(np.int32) for segs in split]
    if full:
        kept.clear()
        kept.update(fresh)
    for s in [s for s in fresh if len(s) > LONGEST_KEPT]:
        del kept[s]
    if len(kept) > 2 * MOST_KEPT:
        kept.clear()
    return out


def _slices(texts: list[str | None]):
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi] or "") < SLICE_CHARS):
            total += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def round_trips(vocab: PieceBpe, flat: np.ndarray, offsets: np.ndarray, texts: list[str | None]) -> list[bool]:
    """Whether each text's ids decode to it: their bytes are laid out in runs of texts and compared."""
    size = np.array([len(r) for r in vocab.raw])
    first = np.cumsum(size) - size
    table = np.frombuffer(b"".join(vocab.raw), dtype=np.uint8)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 200_000, side="right")) - 1)
        ids = flat[offsets[lo] : offsets[hi]]
        n = size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = table[np.arange(int(ends[-1])) + np.repeat(first[ids] - ends[:-1], n)].tobytes()
        cut = ends[offsets[lo : hi + 1] - offsets[lo]].tolist()
        for a, b, text in zip(cut[:-1], cut[1:], texts[lo:hi]):
            want = (text or "").replace("▁", " ").encode("utf-8", "surrogatepass")
            out.append(raw[a:b] == (b" " + want if want else want))
        lo = hi
    return out


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids, n_tokens and round_trip: whether decoding the ids gives the text back."""

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                ids = encode_slice(texts[lo:hi], vocabulary_path)
                size = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                same = round_trips(vocab, flat, offsets, texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(size), pa.array(same, pa.bool_())],
                    names=[id_col, "token_ids", "n_tokens", "round_trip"],
                )
            give_back()

    schema = StructType().add(id_col, docs.schema[id_col].dataType).add("token_ids", ArrayType(IntegerType())).add("n_tokens", LongType()).add("round_trip", BooleanType())
    return mapped(docs.select(id_col, F.col(text_col).alias("text_")), run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id and the text of its ids (null ids: empty)."""

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [vocab.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return mapped(encoded.select(id_col, F.col(ids_col).alias("ids_")), run, StructType().add(id_col, encoded.schema[id_col].dataType).add("text", StringType()))

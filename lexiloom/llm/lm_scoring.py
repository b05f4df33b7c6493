"""Operator 9: language-model scores of whole texts, by causal self-attention over subword ids.

A text is its lower-cased words, then one end. A word is spelled as ids of a public piece vocabulary. Two attention models of
the same kind share the work: one predicts the class of a word's first id (or the end) from the words before it, in overlapping
windows that score each word once; the other the class of each further id (or the word's end) from the word's ids so far. An id's
share of its class, and the classes' floor, are counts over all training texts. The score is the sum of log10 probabilities.
What a word spells does not depend on its text, so it is scored once per worker and kept.

Counts: every training text sends its distinct words in numbers, summed by shuffle. The FREQUENT most frequent words are broadcast
(12 bytes each); a text's other words are joined with the whole table of counts.

Training: each training text is spelled once and kept as its words' first and last ids. The classes of ids come from all pairs of
neighbouring ids of all training texts, summed by shuffle. The first weights are learnt in STEPS steps over as many windows, drawn by hash,
as these steps take. Then ROUNDS rounds go over everything, each window of each training text in exactly one of them, and so each
distinct word: a word counted c times comes in ceil(c / COPY) rows that share its count as weight. A round deals windows by hash to groups of
about GROUP_WORDS words, and words to groups of GROUP_SHARES rows; each group goes on from the weights so far, and the
groups' weights are averaged row by row, weighted by the windows that touched them. So nothing is learnt from a part of the corpus alone,
no weight depends on how the table is cut, and nothing but windows, words and weights leaves the tasks. Words are told apart by 64-bit
hashes where texts meet counts. Within a word, ids see the word's own ids only; across words the first and last id of each word stand for it.

Defined results: null and empty texts consist of the end alone; without training rows N = V = 0, the base probability is 1 for
every token, n_known is 0 and the models keep their first weights. Repeated rows are scored each and counted each. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import Attention, Trainer, cluster, company, most_frequent, summed, windows
from .shared import LOWER, give_back, mapped, mix, text_chunks, word_spans, words, written

#: Steps of the first weights, and their rate at first.
STEPS, RATE = 2000, 0.02
ROUNDS, ROUND_RATE = 2, 0.003
#: Words of a group's windows, and word_shares of a group, about.
GROUP_WORDS, GROUP_SHARES = 1_000_000, 250_000
#: Occurrences of a word that one row of word_shares stands for, at most.
COPY = 64
TRAIN_BATCH = 48
#: Pairs of neighbouring ids that a task holds, and the groups that they are summed in.
MOST_PAIRS, PARTS = 1 << 22, 256
FREQUENT = 300_000
#: Classes of a word's first id, and of the ids within words.
WORD_CLASSES, PIECE_CLASSES = 192, 384
#: Words whose spelling a worker keeps (24 bytes each).
MOST_SPELLED = 1_000_000
#: Text that a worker's arrays hold at a time (a longer text is taken alone).
CHUNK_BYTES = 1 << 20
WORD_BLOCK, PIECE_BLOCK = 16, 4
#: Windows whose words a group spells at a time.
WINDOWS = 4096

_models: dict[str, object] = {}


def _pieces(path: str):
    import sentencepiece

    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def word_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Lower-cased bytes of some words end to end, and their offsets."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size) + np.repeat(starts, size)
    return LOWER[data[at]], offsets


def spell(path: str, raw: np.ndarray, offsets: np.ndarray):
    """Ids of words, end to end, and offsets."""
    text, pieces = raw.tobytes(), _pieces(path)
    flat, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for lo in range(0, len(offsets) - 1, 10_000):
        cut = offsets[lo : lo + 10_001].tolist()
        ids = pieces.encode([text[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])], num_threads=1)
        sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        flat.append(np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes[-1].sum())))
    return np.concatenate(flat), np.cumsum(np.concatenate(sizes))


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h, word, c over all rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, data, offsets in text_chunks(batch, "text_", most_bytes=CHUNK_BYTES):
                starts, ends, _, h = words(data, offsets)
                if not len(h):
                    continue
                u, first, back = distinct(h)
                count = np.bincount(back)
                raw, cut = word_bytes(data, starts[first], ends[first])
                text = pa.LargeStringArray.from_buffers(len(u), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), text, pa.array(count.astype(np.int64))], names=["h", "word", "c"])

    rows = mapped(docs.select(F.col(text_col).alias("text_")), run, "h long, word string, c long")
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"))


def _pair_rows(keys: np.ndarray, times: np.ndarray):
    """Rows (part, keys, times) of pairs of neighbouring ids, summed."""
    keys, times = summed(keys, times)
    part = keys % PARTS
    order = np.argsort(part.astype(np.uint16), kind="stable")
    cut = np.searchsorted(part[order], np.arange(PARTS + 1)).tolist()
    keys, times = keys[order].astype("<i8").tobytes(), times[order].astype("<i8").tobytes()
    for k in range(PARTS):
        if cut[k] < cut[k + 1]:
            yield k, keys[8 * cut[k] : 8 * cut[k + 1]], times[8 * cut[k] : 8 * cut[k + 1]]


def neighbours(pairs: DataFrame, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of neighbouring ids (rows part, keys, times), the cells of `company` and their counts: at most two for each id and
    frequent id."""
    n_ids = len(slot)

    def run(table):
        import pyarrow as pa

        keys, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("keys", "times"))
        keys, times = summed(keys, times)
        cells, many = company(keys // n_ids, keys % n_ids, slot, times)
        return pa.table({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(many.astype(np.float32))})

    got = pairs.groupBy("part").applyInArrow(run, "cell int, n float").toArrow()
    return summed(got.column("cell").to_numpy().astype(np.int64), got.column("n").to_numpy().astype(np.float64))


def piece_counts(counts: DataFrame, path: str, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Over all training words: how often each id begins a word, goes on in one, and ends one; and the pairs of ids within words."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((3, n_ids), dtype=np.int64)
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            column = batch.column(0).cast(pa.large_string())
            n = len(column)
            if not n:
                continue
            cut = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
            raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[cut[0] : cut[-1]]
            ids, offsets = spell(path, raw, cut - cut[0])
            weight = np.repeat(np.asarray(batch.column(1)), np.diff(offsets))
            begins = np.zeros(len(ids), dtype=bool)
            begins[offsets[:-1]] = True
            ends = np.zeros(len(ids), dtype=bool)
            ends[offsets[1:] - 1] = True
            for k, pick in enumerate((begins, ~begins, ends)):
                total[k] += np.bincount(ids[pick], weights=weight[pick], minlength=n_ids).astype(np.int64)
            at = np.flatnonzero(~begins)
            keys.append(ids[at - 1] * n_ids + ids[at])
            times.append(weight[at])
            if sum(map(len, keys)) > MOST_PAIRS:
                keys, times = ([x] for x in summed(np.concatenate(keys), np.concatenate(times)))
            if len(keys) == 1 and len(keys[0]) > MOST_PAIRS // 2:
                yield pair_batch(keys[0], times[0])
                keys, times = [keys[0][:0]], [times[0][:0]]
        k, i = np.nonzero(total)
        none = pa.nulls(len(k), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i]), none, none], names=["k", "part", "n", "keys", "times"])
        yield pair_batch(np.concatenate(keys), np.concatenate(times))

    def pair_batch(keys, times):
        import pyarrow as pa

        part, keys, times = zip(*_pair_rows(keys, times)) if len(keys) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([3] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([0] * len(part), pa.int64()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["k", "part", "n", "keys", "times"])

    rows = written(mapped(counts.select("word", "c"), run, "k int, part int, n long, keys binary, times binary"), "piece_counts")
    out = np.zeros((3, n_ids))
    for r in rows.where("k < 3").groupBy("k", "part").agg(F.sum("n").alias("n")).collect():  # at most 3 * n_ids rows
        out[r.k, r.part] = r.n
    return out[0], out[1], out[2], rows.where("k = 3").select("part", "keys", "times")


def spelled_texts(train: DataFrame, path: str) -> DataFrame:
    """key, ids of each text: what tells it apart, and the first and last id of each of its words (four bytes a word)."""
    if _pieces(path).get_piece_size() > 1 << 16:
        raise ValueError("ids of more than two bytes")

    def run(batches):
        import pyarrow as pa

        kept = _models.setdefault(("ends", path), Kept())

        def make(lack):
            ids, cut = spell(path, *word_bytes(data, starts[where[lack]], ends[where[lack]]))
            return ((ids[cut[:-1]] | ids[cut[1:] - 1] << 16).astype(np.uint32),)

        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text", most_bytes=CHUNK_BYTES):
                starts, ends, doc, h = words(data, offsets)
                count = np.bincount(doc, minlength=part.num_rows)
                both = np.zeros(0, np.uint32)
                if len(h):
                    u, where, back = distinct(h)
                    both = kept.values(u, make)[0][back]
                cut = np.concatenate([[0], np.cumsum(4 * count)])
                raw = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(both.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), raw], names=["key", "ids"])

    key = F.xxhash64(*[c for c in ("id", "text") if c in train.columns])
    return mapped(train.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text")), run, "key long, ids binary")


def _ids_of(column):
    """The pairs of ids of a binary Arrow column, end to end, and how many each row has."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    cut = np.frombuffer(column.buffers()[1], np.int64, column.offset + len(column) + 1)[column.offset :]
    raw = column.buffers()[2]
    return np.frombuffer(raw, "<u4", int(cut[-1] - cut[0]) // 4, int(cut[0])) if raw is not None and cut[-1] > cut[0] else np.zeros(0, np.uint32), np.diff(cut) // 4


def word_pairs(spelled: DataFrame, n_ids: int) -> DataFrame:
    """Rows (part, keys, times) of the first ids of neighbouring words in all texts."""

    def flush(keys):
        import pyarrow as pa

        keys = np.concatenate(keys)
        part, keys, times = zip(*_pair_rows(keys, np.ones(len(keys), np.int64))) if len(keys) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], names=["part", "keys", "times"])

    def run(batches):
        held = [np.zeros(0, np.int64)]
        for batch in batches:
            pairs, count = _ids_of(batch.column(0))
            first = (pairs & np.uint32(0xFFFF)).astype(np.int64)
            same = np.ones(max(len(first) - 1, 0), bool)
            ends = np.cumsum(count) - 1
            same[ends[(ends >= 0) & (ends < len(same))]] = False
            held.append((first[:-1] * n_ids + first[1:])[same])
            if sum(map(len, held)) > MOST_PAIRS:
                yield flush(held)
                held = [np.zeros(0, np.int64)]
        yield flush(held)

    return mapped(spelled.select("ids"), run, "part int, keys binary, times binary")


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes, ascending, and counts of all words counted at least so often that `most` words are, and that bound."""
    least = 1
    steps = counts.groupBy("c").count().orderBy(F.desc("c")).limit(most).toArrow()  # each count stands for a word at least
    total = np.cumsum(steps.column("count").to_numpy())
    fits = np.flatnonzero(total <= most)
    if len(fits) < len(total) or not len(fits):
        least = int(steps.column("c")[int(fits[-1])].as_py()) if len(fits) else 1 << 62
    top = counts.where(F.col("c") >= least).select("h", "c").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("c").to_numpy()[order].astype(np.float64), float(least)


def distinct(h: np.ndarray):
    """Distinct hashes, ascending, where each stands first, and the place of each of h among them."""
    order = np.argsort(h)
    ordered = h[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(h)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return ordered[at], order[at], back


class Kept:
    """What a worker has worked out for words, by hash: MOST_SPELLED of them or fewer, and always those of the last call. Where they become
    more, those asked for once are given up first."""

    def __init__(self):
        self.rows: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def values(self, h: np.ndarray, make) -> tuple[np.ndarray, ...]:
        """Of distinct hashes, ascending, the values; make(places in h) works out those that lack."""
        keys = self.rows[0]
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        lack = np.flatnonzero(~known)
        self.rows[1][at[known]] += 1
        if len(lack):
            fresh, old = (h[lack], np.ones(len(lack), np.int32), *make(lack)), self.rows
            if len(keys) + len(lack) > MOST_SPELLED:
                stay = self.rows[1] > 1
                if stay.sum() > MOST_SPELLED // 2:
                    stay[:] = False
                stay[at[known]] = True
                old = tuple(x[stay] for x in old)
            if len(old) == 2:
                self.rows = fresh
            else:
                put = np.searchsorted(old[0], fresh[0])
                self.rows = tuple(np.insert(x, put, y) for x, y in zip(old, fresh))
            at = np.searchsorted(self.rows[0], h)
        return tuple(x[at] for x in self.rows[2:])


class SubwordModel:
    """The two attention models with their classes and corpus shares."""

    def __init__(self, path: str, texts: list[str | None], first_count: np.ndarray, inner_count: np.ndarray, n_words: int, n_docs: int, steps: int = STEPS):
        """Fitted to a few texts here; `fresh` begins one whose classes and training come from tables."""
        n_ids = len(first_count)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts, ends, doc, _ = words(data, offsets)
        ids, cut = spell(path, *word_bytes(data, starts, ends))
        first, last = ids[cut[:-1]], ids[cut[1:] - 1]
        same = doc[1:] == doc[:-1]
        inside = np.ones(max(len(ids) - 1, 0), dtype=bool)
        inside[cut[1:-1] - 1] = False
        classes = []
        for left, right, n in ((first[:-1][same], first[1:][same], WORD_CLASSES), (ids[:-1][inside], ids[1:][inside], PIECE_CLASSES)):
            count = np.bincount(left, minlength=n_ids) + np.bincount(right, minlength=n_ids)
            slot = most_frequent(count)
            classes.append(cluster(*company(left, right, slot, np.ones(len(left))), count, n, slot))
        self._begin(path, *classes, first_count, inner_count, n_words, n_docs)
        one, two, spans, target = self.word_sequences(first, last, np.bincount(doc, minlength=len(raw)))
        if len(first):
            self.by_word.train(one, two, spans, target, steps=steps, rate=RATE)
            self.by_piece.train(ids, np.full(len(ids), self.bos), cut, self.piece_targets(ids, cut), steps=steps, rate=RATE)

    @classmethod
    def fresh(cls, *given) -> SubwordModel:
        """path, classes of words' first ids and of ids within words, counts of both, words and texts: a model not yet trained."""
        model = cls.__new__(cls)
        model._begin(*given)
        return model

    def _begin(self, path, word_class, piece_class, first_count, inner_count, n_words, n_docs):
        self.path, self.word_class, self.piece_class, self.bos = path, word_class, piece_class, len(first_count)
        self.word_share, self.word_in = self._shares(first_count, word_class, WORD_CLASSES, n_docs)
        self.piece_share, self.piece_in = self._shares(inner_count, piece_class, PIECE_CLASSES, n_words)
        self.by_word = Attention.fresh(self.bos + 1, WORD_CLASSES + 1, WORD_BLOCK, seed=1)
        self.by_piece = Attention.fresh(self.bos + 1, PIECE_CLASSES + 1, PIECE_BLOCK, seed=2)
        self.by_word.p["shift"][:] = np.log(self.word_share)
        self.by_piece.p["shift"][:] = np.log(self.piece_share)

    @staticmethod
    def _shares(count: np.ndarray, classes: np.ndarray, n_classes: int, ends: float):
        """Shares of the classes, the last being the end; and each id's log share of its class."""
        smooth = count + 0.1
        total = np.bincount(classes, weights=smooth, minlength=n_classes)
        share = np.append(total, ends + 0.1)
        return np.maximum(share / share.sum(), 1e-12), np.log(smooth / total[classes])

    def word_sequences(self, first, last, count):
        """Each text's inputs (a beginning, then its words) and the classes of what follows them."""
        spans = np.concatenate([[0], np.cumsum(count + 1)])
        one, two = np.full(spans[-1], self.bos), np.full(spans[-1], self.bos)
        target = np.full(spans[-1], WORD_CLASSES)
        at = np.arange(len(first)) + np.repeat(np.arange(len(count)), count)
        one[at + 1], two[at + 1], target[at] = first, last, self.word_class[first]
        return one, two, spans, target

    def piece_targets(self, ids, cut):
        target = np.full(len(ids), PIECE_CLASSES)
        goes_on = np.ones(len(ids), dtype=bool)
        goes_on[cut[1:] - 1] = False
        at = np.flatnonzero(goes_on)
        target[at] = self.piece_class[ids[at + 1]]
        return target

    def train_on(self, trainers, place, ended, texts: list[bytes], rng) -> None:
        """Steps over windows: the place of each in its text, whether the text ends in it, and its words (those before it included)."""
        found = [t.split() for t in texts]
        flat = [w for ws in found for w in ws]
        ids, cut = spell(self.path, np.frombuffer(b"".join(flat), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in flat])]).astype(np.int64))
        first, last = ids[cut[:-1]], ids[cut[1:] - 1]
        self.word_steps(trainers[0], place, ended, np.array([len(w) for w in found], np.int64), first, last, rng, lambda: ROUND_RATE)

    def word_steps(self, trainer, place, ended, n, first, last, rng, rate) -> None:
        """The same for windows of n words each, whose first and last ids lie end to end."""
        if not len(place):
            return
        base = np.cumsum(n) - n
        begin = place * WORD_BLOCK  # inputs are numbered in the text: the first is its beginning, the next its first word
        low, word = np.maximum(begin - WORD_BLOCK, 0), np.maximum(begin - WORD_BLOCK - 1, 0)  # the first input and the first word that are here
        high = np.where(ended, word + n, begin + WORD_BLOCK - 1)
        size = high - low + 1
        spans = np.concatenate([[0], np.cumsum(size)])
        p = np.arange(spans[-1]) - np.repeat(spans[:-1] - low, size)
        mine, at_end = np.repeat(base - word, size) + p, np.repeat(ended, size) & (p == np.repeat(high, size))
        of = lambda values, at: values[np.clip(at, 0, len(values) - 1)] if len(values) else np.zeros(len(at), np.int64)
        one, two = (np.where(p == 0, self.bos, of(x, mine - 1)) for x in (first, last))
        target = np.where(at_end, WORD_CLASSES, self.word_class[of(first, mine)])
        at = (begin - WORD_BLOCK)[:, None] + np.arange(2 * WORD_BLOCK)
        at = np.where((at >= low[:, None]) & (at <= high[:, None]), at - low[:, None] + spans[:-1, None], -1)
        at = at[rng.permutation(len(at))]
        for lo in range(0, len(at), TRAIN_BATCH):
            some = at[lo : lo + TRAIN_BATCH]
            trainer.step(some, one, two, target, rate() * len(some) / TRAIN_BATCH)  # a rest makes a smaller step

    def piece_steps(self, trainer, raw, offsets, weight, rng, rate) -> None:
        """Steps over words (bytes end to end), each weighted, 1 on average."""
        ids, cut = spell(self.path, raw, offsets)
        if not len(ids):
            return
        at, target, bos, batch = windows(cut, PIECE_BLOCK), self.piece_targets(ids, cut), np.full(len(ids), self.bos), TRAIN_BATCH * WORD_BLOCK // PIECE_BLOCK
        weight = weight[np.searchsorted(cut, at[:, PIECE_BLOCK], side="right") - 1]
        order = rng.permutation(len(at))
        for lo in range(0, len(at), batch):
            some = order[lo : lo + batch]
            trainer.step(at[some], ids, bos, target, rate() * len(some) / batch, weight[some])

    def prepare(self) -> None:
        self.word_tables, self.piece_tables = self.by_word.tables(), self.by_piece.tables()
        self.known = Kept()

    def spelled(self, h, data, starts, ends):
        """Of distinct words, by hash ascending: first id, last id, and log probability of all but the first id's class."""

        def make(lack):
            ids, cut = spell(self.path, *word_bytes(data, starts[lack], ends[lack]))
            target = self.piece_targets(ids, cut)
            part = self.by_piece.log_probabilities(self.piece_tables, ids, np.full(len(ids), self.bos), cut, target, self.piece_share)
            goes_on = np.flatnonzero(target < PIECE_CLASSES)
            part[goes_on] += self.piece_in[ids[goes_on + 1]]
            first, last, short = ids[cut[:-1]], ids[cut[1:] - 1], np.uint16 if self.bos <= 1 << 16 else np.int64
            return first.astype(short), last.astype(short), (np.add.reduceat(part, cut[:-1]) + self.word_in[first]).astype(np.float32)

        return self.known.values(h, make)

    def log10(self, data, offsets, found=None, places=None) -> np.ndarray:
        """log10 probability of each text."""
        n = len(offsets) - 1
        starts, ends, doc, h = found or words(data, offsets)
        u, where, back = places or distinct(h)
        first, last, inner = self.spelled(u, data, starts[where], ends[where]) if len(u) else (np.zeros(0, np.int64),) * 3
        one, two, spans, target = self.word_sequences(first[back], last[back], np.bincount(doc, minlength=n))
        step = self.by_word.log_probabilities(self.word_tables, one, two, spans, target, self.word_share)
        total = np.add.reduceat(step, spans[:-1]) + (np.bincount(doc, weights=inner[back], minlength=n) if len(u) else 0)
        return total / np.log(10)


def _worker_model(raw: bytes) -> SubwordModel:
    """One copy per Python worker, so that what it has spelled lasts over tasks."""
    key = hashlib.sha1(raw).hexdigest()
    if key not in _models:
        for k in [k for k, v in _models.items() if isinstance(v, SubwordModel)]:
            del _models[k]
        _models[key] = pickle.loads(raw)
        _models[key].prepare()
    return _models[key]


_CHANGE = "task int, model int, name string, row int, steps long, weights array<float>"
#: Tasks whose weights are averaged at once.
FAN_IN = 64


def drawn_windows(train: DataFrame, share: float, seed: int, groups: int) -> DataFrame:
    """group, key, place, ended, and text or ids: the windows of the round `seed`, each with the words before it that it looks at. Rounds
    of one share have no window in common until they have had all. train holds texts or spelled_texts."""
    odd, texts = np.uint64(0x9E3779B97F4A7C15), "ids" not in train.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text", most_bytes=CHUNK_BYTES) if texts else [(batch, None, None)]:
                if texts:
                    starts, ends, doc = word_spans(data, offsets)
                    count = np.bincount(doc, minlength=part.num_rows)
                else:
                    pairs, count = _ids_of(part.column(1))
                key = np.asarray(part.column(0)).view(np.uint64)
                before = np.cumsum(count) - count
                blocks = count // WORD_BLOCK + 1
                of = np.repeat(np.arange(len(count)), blocks)
                place = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                draw = mix(mix(key + odd)[of] + (place + 1).astype(np.uint64) * odd)
                pick = np.flatnonzero(((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 - seed * share) % 1.0 < share)
                if not len(pick):
                    continue
                of, place = of[pick], place[pick]
                low, high = np.maximum(place * WORD_BLOCK - WORD_BLOCK - 1, 0) + before[of], np.minimum((place + 1) * WORD_BLOCK, count[of]) + before[of]
                if texts:
                    raw, a, b = LOWER[data].tobytes(), starts.tolist(), ends.tolist()
                    lines = pa.array([b" ".join([raw[a[w] : b[w]] for w in range(lo, hi)]) for lo, hi in zip(low.tolist(), high.tolist())], pa.binary())
                else:
                    cut = np.concatenate([[0], np.cumsum(high - low)])
                    taken = pairs[np.arange(cut[-1]) + np.repeat(low - cut[:-1], high - low)]
                    lines = pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken, "<u4"))])
                group = (mix(draw[pick]) % np.uint64(groups)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(key[of].view(np.int64)), pa.array(place.astype(np.int32)), pa.array((place + 1) * WORD_BLOCK > count[of]), lines], names=["group", "key", "place", "ended", "text" if texts else "ids"])

    rows = train.select(F.xxhash64("text").alias("key"), "text") if texts else train.select("key", "ids")
    return mapped(rows, run, f"group int, key long, place int, ended boolean, {'text' if texts else 'ids'} binary")


def word_shares(counts: DataFrame) -> DataFrame:
    """h, word, copy, weight: each training word, one row for each COPY of its occurrences or fewer, which share them."""
    many = F.ceil(F.col("c") / COPY)
    return counts.select("h", "word", F.explode(F.sequence(F.lit(1), many)).alias("copy"), (F.col("c") / many).alias("weight"))


def drawn_words(counts: DataFrame, share: float, seed: int) -> DataFrame:
    """The word_shares of the round `seed`; those of one share have none in common until they have had all."""
    draw = F.pmod(F.xxhash64("word", "copy", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return word_shares(counts).where(F.pmod(draw + F.lit(math.ceil(seed * share) - seed * share), F.lit(1.0)) < F.lit(float(share)))


def trained_round(model: SubwordModel, train: DataFrame, share: float, seed: int, groups: int = 1, counts: DataFrame | None = None, piece_share: float | None = None, piece_groups: int = 1, mean_weight: float = 1.0, steps: int = 0) -> SubwordModel:
    """The model after one round: groups of windows, and of words, train copies of it, which are averaged row by row, FAN_IN groups at a
    time, so that no task grows with the number of groups. train holds texts, or spelled_texts beside their counts. With steps, one group of
    either kind goes over its share again until it has made so many, its rate falling."""
    if counts is None:
        counts, train = word_counts(train, "", "text"), spelled_texts(train, model.path)
    held = train.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    rate = (lambda t: 0.0 if t >= steps else RATE * min(1.0, (t + 1) / 20) * (1 - 0.9 * (t + 1) / steps)) if steps else lambda t: ROUND_RATE

    def result(group, k, trainer):
        import pyarrow as pa

        parts = [_changes(group, k, *x) for x in trainer.changes()]
        give_back()
        return pa.concat_tables(parts) if parts else _changes(group, k, "", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.float32))

    def by_word(key, table):
        import pyarrow as pa

        group, net = key[0].as_py(), pickle.loads(held.value)
        table = table.sort_by([("key", "ascending"), ("place", "ascending")])
        table = table.take(pa.array(np.random.default_rng([seed, group]).permutation(table.num_rows)))
        rng, trainer = np.random.default_rng([seed, group, 1]), Trainer(net.by_word)
        while True:
            for lo in range(0, table.num_rows, WINDOWS):
                part = table.slice(lo, WINDOWS)
                pairs, n = _ids_of(part.column("ids"))
                first, last = (pairs & np.uint32(0xFFFF)).astype(np.int64), (pairs >> np.uint32(16)).astype(np.int64)
                net.word_steps(trainer, part.column("place").to_numpy().astype(np.int64), part.column("ended").to_numpy(zero_copy_only=False).astype(bool), n, first, last, rng, lambda: rate(trainer.t))
                if steps and trainer.t >= steps:
                    break
            if trainer.t >= steps or not trainer.t:
                return result(group, 0, trainer)

    def by_piece(key, table):
        import pyarrow as pa

        group, net = key[0].as_py(), pickle.loads(held.value)
        table = table.sort_by([("h", "ascending"), ("copy", "ascending"), ("word", "ascending")])
        table = table.take(pa.array(np.random.default_rng([seed, group, 2]).permutation(table.num_rows)))
        rng, trainer = np.random.default_rng([seed, group, 3]), Trainer(net.by_piece)
        while True:
            for lo in range(0, table.num_rows, 4 * WINDOWS):
                part = table.slice(lo, 4 * WINDOWS)
                word = [w.encode() for w in part.column("word").to_pylist()]
                net.piece_steps(trainer, np.frombuffer(b"".join(word), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in word])]), part.column("weight").to_numpy() / mean_weight, rng, lambda: rate(trainer.t))
                if steps and trainer.t >= steps:
                    break
            if trainer.t >= steps or not trainer.t:
                return result(group, 1, trainer)

    def mean(table):
        table = table.sort_by([("row", "ascending"), ("task", "ascending")])
        row, steps = table.column("row").to_numpy(), table.column("steps").to_numpy().astype(np.float64)
        values = table.column("weights").combine_chunks().flatten().to_numpy().reshape(len(row), -1).astype(np.float64)
        rows, at = np.unique(row, return_index=True)
        steps_of = np.add.reduceat(steps, at)
        total = np.add.reduceat(values * steps[:, None], at, axis=0) / steps_of[:, None]
        return _changes(table.column("task")[0].as_py(), table.column("model")[0].as_py(), table.column("name")[0].as_py(), rows, steps_of.astype(np.int64), total.astype(np.float32))

    drawn = drawn_windows(train, share, seed, groups).groupBy("group").applyInArrow(by_word, _CHANGE)
    mine = drawn_words(counts, piece_share or share, seed).withColumn("group", F.pmod(F.xxhash64("copy", "word", F.lit(19)), F.lit(piece_groups)).cast("int"))
    tasks, changes = max(groups, piece_groups), drawn.union(mine.groupBy("group").applyInArrow(by_piece, _CHANGE))
    while tasks > 0:
        tasks = 0 if tasks <= FAN_IN else -(-tasks // FAN_IN)
        changes = changes.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int") if tasks else F.lit(0))
        changes = changes.groupBy("task", "model", "name", F.pmod("row", F.lit(32)).alias("part")).applyInArrow(mean, _CHANGE)
    found = changes.toArrow()  # at most the model's own rows
    for k, name, row, values in zip(found["model"].to_pylist(), found["name"].to_pylist(), found["row"].to_pylist(), found["weights"].to_numpy()):
        old = (model.by_word, model.by_piece)[k].p[name]
        old[row if old.ndim > 1 else slice(None)] = values.reshape(old.shape[1:]) if old.ndim > 1 else values
    return model


def _changes(task: int, k: int, name: str, rows: np.ndarray, steps: np.ndarray, values: np.ndarray):
    import pyarrow as pa

    n, same = len(rows), lambda x, kind: pa.array([x] * len(rows), kind)
    weights = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values, np.float32).ravel()))
    return pa.table({"task": same(task, pa.int32()), "model": same(k, pa.int32()), "name": same(name, pa.string()), "row": pa.array(rows.astype(np.int32)), "steps": pa.array(steps.astype(np.int64)), "weights": weights})


def fitted(train: DataFrame, counts: DataFrame, path: str, n_words: int, n_docs: int, shares: int, steps: int, rounds: int) -> SubwordModel:
    """The model of all training texts (id, text), whose words are counted and come in so many word_shares."""
    n_ids = _pieces(path).get_piece_size()
    begins, inner, ends, within = piece_counts(counts, path, n_ids)
    spelled = written(spelled_texts(train, path), "lm_ids")
    classes = []
    for pairs, count, n in ((word_pairs(spelled, n_ids), begins, WORD_CLASSES), (within, begins + 2 * inner - ends, PIECE_CLASSES)):
        slot = most_frequent(count)
        classes.append(cluster(*neighbours(pairs, slot), count, n, slot))
    model = SubwordModel.fresh(path, *classes, begins, inner, n_words, n_docs)
    if not n_words:
        return model
    given = {"counts": counts, "mean_weight": n_words / shares}
    n_windows = n_words / WORD_BLOCK + n_docs
    if steps:
        model = trained_round(model, spelled, min(1.0, steps * TRAIN_BATCH / n_windows), 0, piece_share=min(1.0, steps * TRAIN_BATCH * WORD_BLOCK / PIECE_BLOCK / shares), steps=steps, **given)
    for k in range(rounds):
        model = trained_round(model, spelled, 1 / rounds, k, math.ceil(n_words / rounds / GROUP_WORDS), piece_groups=math.ceil(shares / rounds / GROUP_SHARES), **given)
    return model


def lm_scores(docs: DataFrame, vocabulary_path: str, held_out, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """held_out: boolean column of docs. Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where("not held_out")
    counts = written(word_counts(train, "id", "text"), "word_counts")
    kinds, n_words, shares = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.sum(F.ceil(F.col("c") / COPY))).first()
    n_docs = train.select("id").count()
    total, distinct_words = n_words + n_docs, kinds + (n_docs > 0)
    model = fitted(train.select("id", "text"), counts, vocabulary_path, n_words, n_docs, shares or 0, steps, rounds)
    top_h, top_c, least_c = frequent_words(counts, frequent)
    held = spark.sparkContext.broadcast((pickle.dumps(model), top_h, top_c))
    unit = np.log10(total + 0.1 * (distinct_words + 1))

    def run(batches):
        import pyarrow as pa

        raw, keys, c = held.value
        net = _worker_model(raw)
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text", most_bytes=CHUNK_BYTES):
                n = part.num_rows
                found = words(data, offsets)
                _, _, doc, h = found
                places = distinct(h)
                u, back = places[0], places[2]
                score = net.log10(data, offsets, found, places)
                size = np.bincount(doc, minlength=n)
                at = np.minimum(np.searchsorted(keys, u), max(len(keys) - 1, 0))
                hit = keys[at] == u if len(keys) else np.zeros(len(u), bool)
                value = np.log10((c[at] if len(keys) else np.zeros(len(u))) * hit + 0.1)[back]
                hit = hit[back]
                base = np.bincount(doc[hit], weights=value[hit], minlength=n) + np.log10(n_docs + 0.1)
                known = np.bincount(doc[hit], minlength=n) + (n_docs > 0)
                rare = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(h[~hit].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), lists], names=["id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = mapped(rows, run, f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm_rows")
    others = counts.where(F.col("c") < least_c).groupBy("h").agg(F.sum("c").alias("c"))
    seen = scored.select("row", F.explode("rare").alias("h")).join(others, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1))).alias("gain"))
    out = scored.join(seen, "row", "left")
    base = F.col("base") + F.size("rare") * F.log10(F.lit(0.1)) + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * float(unit)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

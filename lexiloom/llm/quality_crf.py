"""Operator 7: document quality from a linear-chain conditional random field over lines.

Every line gets features of its bytes (shares of capitals, digits, symbols, bars, exclamation marks, word lengths, repeats within
the document, ...), its neighbours' features beside its own. The chain's two labels are bad and good; forward-backward gives each
line's probability of being good, and the mean of these, weighted by line length, is the document's. A logistic link fitted on the
same labelled rows maps that mean to the score, so that 0.5 parts the two labels best.

Training has labels of documents only: each line of a labelled document stands with its document's label, so no chain that the fit
sees changes its label, and the learned steps between labels strongly favour staying: most documents come out with lines of one
kind. The model is fitted
on a bounded sample of the labelled rows: of each label the most_labelled rows with the smallest hash of their id, whole texts.

Defined results: a null text counts as empty, an empty text as one empty line; repeated rows score alike; a labelled id that
occurs several times counts once per row; without rows of both labels every score is 0.5. Labels, lang, source and ids are
no features. Long documents are scored whole; nothing is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .shared import give_back, joined_chunks, mapped, mix, text_chunks, words

#: Labelled rows of each label that the fit reads at most.
MOST_LABELLED = 1000
STEPS = 150

_KIND = np.zeros(256, dtype=np.int64)  # 0 other
_KIND[97:123] = 1
_KIND[128:256] = 1  # letters, mostly, in the bytes beyond ASCII
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[list(b".?;:")] = 5
_KIND[[44]] = 6
_KIND[[33]] = 7
_KIND[[124]] = 8
_KIND[list(b"#$%&*+=<>_~^@\\/{}[]")] = 9
N_KINDS = 10


def line_features(data: np.ndarray, offsets: np.ndarray):
    """Features of every line of concatenated texts; the document of each line; line lengths in bytes."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # by owner first: where texts are empty, several of them start at one position
    owner = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, side="right") - 1])
    place = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((place, owner))
    starts, doc = place[order], owner[order]
    ends = np.empty(len(starts), dtype=np.int64)
    ends[:-1] = np.where(doc[1:] == doc[:-1], starts[1:] - 1, offsets[doc[:-1] + 1])
    ends[-1:] = offsets[doc[-1:] + 1]
    size = ends - starts
    kind = _KIND[data]
    total = np.empty((N_KINDS, len(starts)))
    for k in range(N_KINDS):
        run = np.concatenate([[0], np.cumsum(kind == k)])
        total[k] = run[ends] - run[starts]
    w_start, w_end, w_doc, w_hash = words(data, offsets)
    line_of = np.searchsorted(starts, w_start, side="right") - 1
    n = len(starts)
    n_words = np.bincount(line_of, minlength=n).astype(float)
    length = (w_end - w_start).astype(float)
    short = np.bincount(line_of, weights=length <= 3, minlength=n)
    letters = np.bincount(line_of, weights=length, minlength=n)
    decorated = np.bincount(line_of, weights=kind[w_end - 1] == 9, minlength=n) if len(w_end) else np.zeros(n)
    shouted = np.bincount(line_of, weights=kind[w_end - 1] == 7, minlength=n) if len(w_end) else np.zeros(n)
    # lines and words that the document has several times
    line_hash = np.zeros(n, dtype=np.uint64)
    echo = np.zeros(n)
    if len(w_hash):
        inside = np.arange(len(line_of)) - np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int64)[line_of]
        np.add.at(line_hash, line_of, mix(w_hash + inside.astype(np.uint64)))
        echo = np.bincount(line_of[1:], weights=(w_hash[1:] == w_hash[:-1]) & (line_of[1:] == line_of[:-1]), minlength=n)
    key = mix(line_hash ^ (doc.astype(np.uint64) << np.uint64(32)))
    _, back, seen = np.unique(key, return_inverse=True, return_counts=True)
    repeated = (seen[back] > 1) & (n_words > 0)
    if len(w_hash):
        _, back, seen = np.unique(mix(w_hash ^ (w_doc.astype(np.uint64) << np.uint64(32))), return_inverse=True, return_counts=True)
        rare = np.bincount(line_of, weights=seen[back] == 1, minlength=n)
    else:
        rare = np.zeros(n)
    chars, some = np.maximum(size, 1), np.maximum(n_words, 1)
    last_kind = np.where(size > 0, kind[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    first_kind = np.where(size > 0, kind[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
    x = np.column_stack([
        *(total[k] / chars for k in (1, 2, 3, 5, 6, 7, 8, 9, 0)),
        total[2] > 0.6 * chars, total[8] > 0, total[9] / some, total[7] / some, total[8] / some, decorated / some, shouted / some,
        short / some, np.minimum(letters / some, 20) / 10, np.log1p(n_words) / 3, repeated, rare / some, echo / some,
        last_kind == 5, first_kind == 2, n_words == 0,
    ]).astype(np.float64)
    return x, doc, size


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features, a bias, and flags for a document's first and last line."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (doc[1:] == doc[:-1]).astype(x.dtype)
    before[1:] = x[:-1] * same[:, None]
    after[:-1] = x[1:] * same[:, None]
    first, last = np.ones(n, x.dtype), np.ones(n, x.dtype)
    first[1:], last[:-1] = 1 - same, 1 - same
    return np.column_stack([x, before, after, first, last, np.ones(n, x.dtype)])


def marginals(emission: np.ndarray, doc: np.ndarray, n_docs: int, step: np.ndarray, weight: np.ndarray | float = 1.0):
    """Forward-backward over all chains at once, one line position at a time. Returns P(label) of each line, the expected
    count of each transition, and the log partition functions' sum, the last two with each document's weight."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    by = np.argsort(-count, kind="stable")
    live = np.searchsorted(-count[by], -np.arange(1, int(count.max(initial=0)) + 1), side="right")
    top = emission.max(axis=1, keepdims=True)
    e, m = np.exp(emission - top), np.exp(step)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    for p, k in enumerate(live):
        at = first[by[:k]] + p
        a = e[at] if p == 0 else (alpha[at - 1] @ m) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    for p in range(len(live) - 2, -1, -1):
        at = first[by[: live[p + 1]]] + p
        beta[at] = ((e[at + 1] * beta[at + 1]) @ m.T) / scale[at + 1, None]
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    weight = np.broadcast_to(weight, n_docs)[doc]
    pair = (alpha[inner] * weight[inner, None]).T @ (e[inner + 1] * beta[inner + 1] / scale[inner + 1, None]) * m
    return gamma, pair, float(((np.log(scale) + top[:, 0]) * weight).sum())


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # features x 2
    step: np.ndarray  # 2 x 2
    slope: float
    shift: float

    def line_quality(self, data, offsets):
        """P(good) of each line, its document and its length."""
        x, doc, size = line_features(data, offsets)
        emission = with_neighbours((x - self.mean) / self.spread, doc) @ self.weights
        gamma, _, _ = marginals(emission, doc, len(offsets) - 1, self.step)
        return gamma[:, 1], doc, size

    def scores(self, data, offsets) -> np.ndarray:
        good, doc, size = self.line_quality(data, offsets)
        return link(weighted_mean(good, doc, size, len(offsets) - 1), self.slope, self.shift)


def weighted_mean(good, doc, size, n_docs):
    weight = size + 1.0
    return np.bincount(doc, weights=good * weight, minlength=n_docs) / np.bincount(doc, weights=weight, minlength=n_docs)


def _odds(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def link(mean, slope, shift):
    return 1 / (1 + np.exp(-np.clip(slope * _odds(mean) + shift, -30, 30)))


def loss(theta: np.ndarray, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """What the fit makes small, and its slope: minus the log likelihood of the labels (y: of each document, that of all its lines), each document with its weight,
    and a small ridge. theta: weights of features by label, then the 2 x 2 weights of steps."""
    w, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
    emission = (x @ w.astype(x.dtype)).astype(float)
    gamma, pair, z = marginals(emission, doc, len(y), step, weight)
    line, truth = weight[doc], y[doc]
    same = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[same], truth[same + 1]), line[same])
    value = z - float((emission[np.arange(len(doc)), truth] * line).sum()) - float((seen * step).sum()) + 0.5e-4 * float((w * w).sum()) + 0.5e-2 * float((step * step).sum())
    grad_w = x.T @ ((gamma - np.eye(2)[truth]) * line[:, None]).astype(x.dtype) + 1e-4 * w
    return value, np.concatenate([grad_w.ravel(), (pair - seen + 1e-2 * step).ravel()])


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS) -> QualityModel:
    """Maximum likelihood with a small ridge by Adam; both labels weigh alike, and a document counts once, however many lines it has."""
    y = np.array(labels, dtype=np.int64)
    if len(texts) == 0 or y.min() == y.max():
        n = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
        return QualityModel(np.zeros(n), np.ones(n), np.zeros((3 * n + 3, 2)), np.zeros((2, 2)), 0.0, 0.0)
    parts = [(lo, *line_features(data, offsets)) for lo, data, offsets in joined_chunks(texts)]
    x, doc, size = (np.concatenate(p) for p in ([x for _, x, _, _ in parts], [doc + lo for lo, _, doc, _ in parts], [size for _, _, _, size in parts]))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = with_neighbours(((x - mean) / spread).astype(np.float32), doc)
    lines = np.bincount(doc, minlength=len(y)).astype(float)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    n_docs = len(y)
    theta = np.zeros(x.shape[1] * 2 + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, g = loss(theta, x, doc, y, share / lines)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    w, step = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
    gamma, _, _ = marginals((x @ w.astype(x.dtype)).astype(float), doc, n_docs, step)
    z = _odds(weighted_mean(gamma[:, 1], doc, size, n_docs))
    slope, shift = 1.0, 0.0
    prior = np.full(len(y), 1.0 / len(y))
    for _ in range(200):  # Newton steps on a two-parameter logistic link
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([(prior * (p - y) * z).sum() + 1e-3 * (slope - 1), (prior * (p - y)).sum()])
        h = prior * p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        slope, shift = slope - 0.5 * move[0], shift - 0.5 * move[1]
    return QualityModel(mean, spread, w, step, float(slope), float(shift))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Texts and labels of at most `most` labelled rows of each label, those with the smallest hash of their id."""
    marks = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("label_")).where("id_ is not null and label_ in (0, 1)").distinct()
    picked = None
    for label in (0, 1):
        part = marks.where(F.col("label_") == label).orderBy(F.xxhash64("id_"), "id_").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(picked), "id_").select("id_", "label_", "text_").collect()
    rows.sort(key=lambda r: (r.id_, r.label_, r.text_ or ""))
    return [r.text_ for r in rows], [r.label_ for r in rows]


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in keep, score and predicted for every row. What is kept may bear any names but the last two."""
    if {"score", "predicted"} & {id_col, *keep}:
        raise ValueError("columns named score or predicted can't be kept beside the results; score_rows keeps any")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, *keep)))).alias("row"), F.col(f"`{text_col}`").alias("text_"))
    return _scored(rows, model, None).select("row.*", "score", "predicted")


def score_rows(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """row (all columns of docs, whatever their names), score and predicted for every row."""
    return _scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), model, docs.columns.index(text_col))


def _scored(rows: DataFrame, model: QualityModel, at: int | None) -> DataFrame:
    """rows: row, and the text in a column of its own or in the field of row at that place."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(1) if at is None else batch.column(0).field(at)
            both = pa.RecordBatch.from_arrays([batch.column(0), text], names=["row", "text_"])
            for part, data, offsets in text_chunks(both, "text_"):
                s = held.value.scores(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    return mapped(rows, run, StructType().add("row", rows.schema["row"].dataType).add("score", DoubleType()).add("predicted", IntegerType()))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, **columns) -> QualityModel:
    model = fit(*labelled_sample(docs, labels, most, **columns))
    give_back()
    return model

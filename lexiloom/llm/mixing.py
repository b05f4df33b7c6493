"""Operator 6: mixing towards target weights by soft domain membership.

A classifier learned from the labelled table gives every document a posterior over domains (the combinations of label columns).
Document rates r >= least then solve a least-squares problem: the expected token total of domain k, sum of r * tokens * posterior_k,
shall equal the target. Distributed projected-gradient descent fits them: each step one job sums K numbers, the driver
keeps the steps' gradients (K numbers each), and a task works out its documents' rates from those, so nothing is rewritten and
nothing but sums leaves the executors. Gradients are scaled by tokens and by domain, so few steps do.

The whole budget is set so that the anchor domain's target is what it has: its documents keep rates near one.

Bounded: the classifier is fitted on at most MOST_LABELLED rows of each domain, those with the smallest hash of their id, whole
texts. Everything else covers all rows.

Defined results: tokens are words; a text without words (null, empty) has no tokens, the classifier's shifts as posterior, and a rate that
changes no total. Repeated rows are rated each. A domain without labelled rows has no posterior and its weight is dealt to the others in proportion; without
any labelled rows there is one domain and every rate is 1. Labels and other columns of the documents are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .shared import give_back, joined_chunks, mapped, text_chunks, words, written

MOST_LABELLED = 500
BUCKET_BITS = 22
#: Word buckets that the classifier looks at, at most, and the likelihood ratio that each must reach.
FEATURES = 256
LEAST_SURPRISE = 45.0
STEPS = 40
#: Fitting ends when no domain is off its target by more than this share of all tokens.
CLOSE = 1e-3

_GROUPS = np.zeros(256, dtype=np.int64)
_GROUPS[97:123] = 1
_GROUPS[65:91] = 2
_GROUPS[48:58] = 3
_GROUPS[[32, 9, 11, 12, 13]] = 4
_GROUPS[10] = 5
_GROUPS[list(b".,;:?!")] = 6
_GROUPS[33:48] = np.where(_GROUPS[33:48] == 0, 7, _GROUPS[33:48])
_GROUPS[91:97] = 7
_GROUPS[123:127] = 7
_GROUPS[128:] = 8
_N_GROUPS = 9


@dataclass(frozen=True)
class DomainModel:
    names: tuple[str, ...]
    slot: np.ndarray  # bucket -> feature, or -1
    weights: np.ndarray  # features and byte groups x domains
    shift: np.ndarray

    def posteriors(self, data, offsets):
        """Posterior of each text, and its number of words."""
        n = len(offsets) - 1
        doc, bucket, size = _buckets(data, offsets)
        z = _design(self.slot, doc, bucket, data, offsets) @ self.weights + self.shift
        z[size == 0] = self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), size.reshape(n)


def _buckets(data, offsets):
    """Of each run of letters and digits its text and its bucket; and the number of words of each text."""
    _, _, whole, _ = words(data, offsets)
    _, _, doc, h = words(np.where((_GROUPS[data] == 6) | (_GROUPS[data] == 7), np.uint8(32), data), offsets)
    return doc, (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.bincount(whole, minlength=len(offsets) - 1)


def _design(slot, doc, bucket, data, offsets) -> np.ndarray:
    """Whether a text has each feature's words, and its byte groups."""
    n, m = len(offsets) - 1, int(slot.max(initial=-1)) + 1
    x = np.zeros((n, m + _N_GROUPS), dtype=np.float32)
    hit = slot[bucket] >= 0
    x[doc[hit], slot[bucket[hit]]] = 1
    x[:, m:] = _group_shares(data, offsets)
    return x


def _group_shares(data, offsets) -> np.ndarray:
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(of * _N_GROUPS + _GROUPS[data], minlength=n * _N_GROUPS).reshape(n, _N_GROUPS)
    return table / np.maximum(np.diff(offsets), 1)[:, None] * 4


def fit(texts: list[str | None], domain: list[int], names: tuple[str, ...], rows: list[int] | None = None, steps: int = 400) -> DomainModel:
    """Softmax regression by Adam over byte groups and the FEATURES word buckets whose presence sets domains apart most surely;
    a domain weighs as the labelled rows (given in rows) that its sample stands for."""
    k = len(names)
    slot = np.full(1 << BUCKET_BITS, -1, dtype=np.int16)
    if k < 2:
        return DomainModel(names, slot, np.zeros((_N_GROUPS, k)), np.zeros(k))
    y, pairs, groups = np.array(domain), [], []
    for lo, data, offsets in joined_chunks(texts):
        doc, bucket, _ = _buckets(data, offsets)
        pairs.append(np.unique(((doc + lo) << BUCKET_BITS) | bucket))
        groups.append(_group_shares(data, offsets))
    pair = np.concatenate(pairs)
    met, place = np.unique(pair & ((1 << BUCKET_BITS) - 1), return_inverse=True)
    of = y[pair >> BUCKET_BITS]
    have = np.stack([np.bincount(place[of == d], minlength=len(met)) for d in range(k)], axis=1).astype(float)
    n_of = np.bincount(y, minlength=k).astype(float)
    expected = have.sum(axis=1, keepdims=True) * n_of / len(y)
    surprise = (2 * have * np.log(np.maximum(have, 1e-9) / np.maximum(expected, 1e-9))).max(axis=1)  # likelihood ratio
    best = np.argsort(-surprise, kind="stable")[:FEATURES]
    best = best[surprise[best] >= LEAST_SURPRISE]
    slot[met[best]] = np.arange(len(best))
    x = np.zeros((len(y), len(best) + _N_GROUPS), dtype=np.float32)
    x[:, len(best) :] = np.concatenate(groups)
    feature = slot[pair & ((1 << BUCKET_BITS) - 1)]
    x[pair[feature >= 0] >> BUCKET_BITS, feature[feature >= 0]] = 1
    prior = np.array(rows, dtype=float) if rows else n_of
    weight = (prior / prior.sum() / n_of)[y][:, None]
    truth = np.eye(k)[y]
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = (x @ w).astype(float) + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        e = (z / z.sum(axis=1, keepdims=True) - truth) * weight
        g = x.T @ e.astype(np.float32) + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = (w - 0.03 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        b -= 0.3 * e.sum(axis=0)
    return DomainModel(names, slot, w.astype(float), b)


def domain_name(columns: tuple[str, ...]):
    """Column: the name of a labelled row's domain, like quality1_toxic0; null where a label is."""
    return F.concat_ws("_", *(F.concat(F.lit(c), F.col(c).cast("string")) for c in columns))


def train(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    marks = labels.where(" and ".join(f"`{c}` is not null" for c in columns)).select(F.col(id_col).alias("id_"), domain_name(columns).alias("domain_")).where("id_ is not null").distinct()
    total = {r.domain_: r["count"] for r in marks.groupBy("domain_").count().collect()}
    picked = None
    for name in sorted(total):
        part = marks.where(F.col("domain_") == name).orderBy(F.xxhash64("id_"), "id_").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return fit([], [], ("all",))
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(picked), "id_").select("id_", "domain_", "text_").collect()
    rows.sort(key=lambda r: (r.id_, r.domain_, r.text_ or ""))
    names = tuple(sorted({r.domain_ for r in rows})) or ("all",)
    model = fit([r.text_ for r in rows], [names.index(r.domain_) for r in rows], names, [total[n] for n in names])
    give_back()
    return model


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of docs (the text only if asked for) under `row`, n_tokens and posterior (in the order of the model's names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    others = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, text = (batch.column(0), batch.column(0).field(at)) if keep_text else (batch.column(0), batch.column(1))
            both = pa.RecordBatch.from_arrays([row, text], names=["row", "text_"])
            for part, data, offsets in text_chunks(both, "text_"):
                p, size = held.value.posteriors(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]).astype(np.int32)), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), lists], names=["row", "n_tokens", "posterior"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), *([] if keep_text else [F.col(f"`{text_col}`").alias("text_")]))
    return mapped(rows, run, StructType().add("row", rows.schema["row"].dataType).add("n_tokens", LongType()).add("posterior", ArrayType(DoubleType())))


def _rates(p: np.ndarray, history: list[np.ndarray], least: float) -> np.ndarray:
    r = np.ones(len(p))
    for g in history:
        r = np.maximum(least, r - p @ g)
    return r


def _array(column) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _sums(rated: DataFrame, history: list[np.ndarray], least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected token totals of the domains at the present rates, and the sum of tokens * posterior * posterior' over the documents
    whose rate is free to fall."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                n, p = np.asarray(batch.column(0), dtype=float), _array(batch.column(1))
                r = _rates(p, history, least)
                total[:k] += (n * r) @ p
                total[k:] += ((p * (n * (r > least))[:, None]).T @ p).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(k + k * k)
    for r in mapped(rated.select("n_tokens", "posterior"), run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out[:k], out[k:].reshape(k, k)


def likeliest_totals(rated: DataFrame, at: int, k: int) -> np.ndarray:
    """Expected token totals of the domains over the documents whose likeliest domain is the one at `at`."""
    mine = F.array_position("posterior", F.array_max("posterior")) == at + 1
    sums = [F.coalesce(F.sum(F.when(mine, F.col("n_tokens") * F.get("posterior", F.lit(i)))), F.lit(0.0)) for i in range(k)]
    return np.array(rated.agg(*sums).first(), dtype=float)


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None, anchor: str, least: float = 0.0, steps: int = STEPS, text_col: str = "text", keep_text: bool = False, close: float = CLOSE):
    """A table of row (the columns of docs, the text only if asked for), n_tokens, posterior and rate; the targets; and the fitted totals.
    Without weights the targets are what the anchor's documents hold by themselves (those that likeliest belong to it): no
    domain's target exceeds its present total, whatever part of the documents or labels lies elsewhere."""
    k = len(model.names)
    rated = written(posteriors(docs, model, text_col, keep_text), "posteriors")
    share = np.array([max((weights or {}).get(n, 0.0), 0.0) for n in model.names])
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    history: list[np.ndarray] = []
    now, outer = _sums(rated, history, least, k)
    tokens = max(now.sum(), 1.0)
    at = model.names.index(anchor) if anchor in model.names else int(np.argmax(share))
    target = share * (now[at] / share[at] if share[at] else tokens)
    if weights is None:
        target = likeliest_totals(rated, at, k) if anchor in model.names else now
    scale = np.maximum(now, 1e-3 * tokens)
    root = 1 / np.sqrt(scale)
    for _ in range(steps):
        off = now - target
        if np.abs(off).max() <= close * tokens or k < 2:
            break
        step = 1 / max(np.linalg.eigvalsh(root[:, None] * outer * root[None])[-1], 1e-9)
        history.append(step * off / scale)
        now, outer = _sums(rated, history, least, k)

    return rated.withColumn("rate", rate_column(history, k, least)), dict(zip(model.names, target.tolist())), dict(zip(model.names, now.tolist()))


def rate_column(history: list[np.ndarray], k: int, least: float):
    """Column: a document's rate from its posterior and the steps' gradients, so that rows need not leave the JVM."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(v)) for v in g)) for g in history))
    fall = lambda g: sum((F.get("posterior", F.lit(i)) * F.get(g, F.lit(i)) for i in range(k)), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(float(least)), r - fall(g)))


def copies(rate, key, nearest: bool = False):
    """Column: how often to take a row. By a hash of its key, so that the expected number is the rate; or the nearest number."""
    u = F.lit(0.5) if nearest else F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("int")

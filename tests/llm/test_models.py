import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import attention, lm_scoring, mixing, quality_crf
from lexiloom.llm.shared import crc32_of_id

from . import brute

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


def labelled(n=160, seed=4):
    rng = random.Random(seed)
    good = lambda: ".\n".join(" ".join(rng.choice("the river ran under old bridges while people walked home".split()) for _ in range(9)).capitalize() for _ in range(4)) + "."
    bad = lambda: "\n".join(" | ".join(rng.choice(["BUY", "$$$", "click", "!!!", "###"]) for _ in range(9)) for _ in range(4))
    return [(i, good() if i % 2 else bad()) for i in range(n)]


def test_quality_is_learnt_and_held_out(spark):
    rows = labelled()
    docs = brute.docs(spark, rows + brute.AWKWARD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows[:100]] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs, labels)
    got = quality_crf.score(docs, model, keep=("lang",)).collect()
    assert len(got) == len(rows) + len(brute.AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = {r.doc_id: r.predicted for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert np.mean([held[i] == i % 2 for i in range(100, 160)]) > 0.95
    assert quality_crf.score(docs.limit(0), model).count() == 0
    assert quality_crf.train(docs, labels.limit(0)).scores(np.zeros(0, np.uint8), np.zeros(2, np.int64)).tolist() == [0.5]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, step = rng.standard_normal((4, 2)), rng.standard_normal((2, 2))
    gamma, pair, z = quality_crf.marginals(e, np.zeros(4, int), 1, step)
    total, one, both = 0.0, np.zeros((4, 2)), np.zeros((2, 2))
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        p = math.exp(sum(e[i, y[i]] for i in range(4)) + sum(step[y[i], y[i + 1]] for i in range(3)))
        total += p
        for i in range(4):
            one[i, y[i]] += p
        for i in range(3):
            both[y[i], y[i + 1]] += p
    assert np.allclose(gamma, one / total) and np.allclose(pair, both / total) and math.isclose(z, math.log(total))


def test_scores_equal_enumerated_chains(spark):
    """Scores of short texts from all label sequences of their lines."""
    rows = labelled()
    model = quality_crf.fit([t for _, t in rows], [i % 2 for i, _ in rows])
    texts = [rows[0][1], rows[1][1], "", "one line", "a\n\nb | c", rows[2][1] + "\n" + rows[3][1], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_crf.score(docs, model).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        x, doc, size = quality_crf.line_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        e = quality_crf.with_neighbours((x - model.mean) / model.spread, doc) @ model.weights
        total, good = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            p = math.exp(sum(e[i, v] for i, v in enumerate(y)) + sum(model.step[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        mean = float((good / total) @ (size + 1) / (size + 1).sum())
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        z = model.slope * math.log(mean / (1 - mean)) + model.shift
        assert abs(got[k] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-6


def test_very_long_texts_in_models(spark):
    long_ = "word of a very long text\n" * 60_000  # 1.5 MB in 60,000 lines
    rows = labelled(60)
    docs = brute.docs(spark, [*rows, (100, long_), (101, "x" * 1_000_000)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality_crf.score(docs, quality_crf.train(docs, labels)).collect()
    assert len(got) == 62 and all(0 <= r.score <= 1 for r in got)
    rated, _, _ = mixing.mix(docs, mixing.train(docs, labels, ("toxic",)), None, anchor="toxic0")
    assert {r.row.doc_id: r.n_tokens for r in rated.collect()}[100] == 360_000
    out = {r.doc_id: r for r in lm_scoring.lm_scores(docs, PATH, F.col("doc_id") >= 100, steps=5, rounds=1).collect()}
    assert out[100].n_tokens == 360_001 and out[101].n_tokens == 2 and all(math.isfinite(r.score) and r.score < 0 for r in out.values())


def test_attention_learns_and_windows_score_each_input_once():
    at = attention.windows(np.array([0, 5, 5, 12]), 4)
    own = at[:, 4:]
    assert sorted(own[own >= 0].tolist()) == list(range(12)) and (at[:, :4] < own[:, :1].max() + 12).all()
    rng = np.random.default_rng(0)
    one = rng.integers(0, 6, 3000)
    target = np.concatenate([[0], one[:-1]]) % 4  # what came two inputs ago, as seen from the next
    model = attention.Attention.fresh(7, 5, 4, seed=3)
    two, spans, share = np.full(3000, 6), np.arange(0, 3001, 60), np.full(5, 0.2)
    before = model.log_probabilities(model.tables(), one, two, spans, target, share).mean()
    model.train(one, two, spans, target, steps=400)
    after = model.log_probabilities(model.tables(), one, two, spans, target, share).mean()
    assert after > before + 0.5


def plain_log_probabilities(model, one, two, offsets, target, share):
    """Every input by itself, in plain loops: it attends to its own block and the one before, not to what follows, and not beyond its
    sequence."""
    p, b, out = model.p, model.block, []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        e = [p["one"][one[i]].astype(float) + p["two"][two[i]] for i in range(lo, hi)]
        for i in range(hi - lo):
            q, start = e[i] @ p["q"], (i // b - 1) * b
            keys = [j for j in range(max(start, 0), i + 1)]
            s = np.array([q @ (e[j] @ p["k"]) / 4 + p["bias"][i % b, j - start] for j in keys])
            a = np.exp(s - s.max())
            h = e[i] + sum(x * (e[j] @ p["v"]) for x, j in zip(a / a.sum(), keys))
            z = h @ p["out"] + p["shift"]
            z = np.exp(z - z.max())
            out.append(math.log((1 - attention.FLOOR) * z[target[lo + i]] / z.sum() + attention.FLOOR * share[target[lo + i]]))
    return out


def test_windows_score_as_one_input_at_a_time():
    rng = np.random.default_rng(4)
    model = attention.Attention.fresh(12, 6, 4, seed=2)
    model.p["bias"][:] = rng.standard_normal((4, 8))
    model.p["shift"][:] = rng.standard_normal(6)
    spans, share = np.array([0, 1, 1, 10, 31]), np.full(6, 1 / 6)
    one, two, target = rng.integers(0, 12, 31), rng.integers(0, 12, 31), rng.integers(0, 6, 31)
    got = model.log_probabilities(model.tables(), one, two, spans, target, share)
    assert np.allclose(got, plain_log_probabilities(model, one, two, spans, target, share), atol=1e-4)


@pytest.mark.parametrize("out, shift", [(1, 1), (1, 30), (200, 1), (1, -300)])
def test_large_logits_score_and_train_as_plain_ones(monkeypatch, out, shift):
    """Logits and shifts on either side of what exp takes without a shift by row, in stretches shorter than the targets, over gaps and starts of sequences."""
    monkeypatch.setattr(attention, "LOGITS", 1)
    rng = np.random.default_rng(5)
    model = attention.Attention.fresh(40, 6, 4, seed=2)
    model.p["out"] *= np.float32(out)
    model.p["shift"][:] = rng.standard_normal(6) * shift
    size = np.array([1, 0, 9, 100, 4, 3])
    spans, share = np.concatenate([[0], np.cumsum(size)]), np.full(6, 1 / 6)
    n = int(spans[-1])
    one, two, target = rng.integers(0, 40, n), rng.integers(0, 40, n), rng.integers(0, 6, n)
    want = plain_log_probabilities(model, one, two, spans, target, share)
    assert np.allclose(model.log_probabilities(model.tables(), one, two, spans, target, share), want, atol=1e-3)
    trainer, at = attention.Trainer(model), attention.windows(spans, 4)
    g = trainer.gradients(at, one, two, target)
    z = np.zeros(6)  # the shift's gradient: mean probabilities less the targets' shares
    for c in range(6):
        z[c] = np.mean((np.exp(plain_log_probabilities(model, one, two, spans, np.full(n, c), share)) - attention.FLOOR / 6) / (1 - attention.FLOOR) - (target == c))
    assert np.allclose(g["shift"], z, atol=1e-4) and all(np.isfinite(x[1] if isinstance(x, tuple) else x).all() for x in g.values())
    before = {k: np.array(v) for k, v in model.p.items()}
    trainer.step(at, one, two, target, 0.01)
    rest = np.setdiff1d(np.arange(40), one)
    assert all(np.abs(model.p[k] - before[k]).max() > 0.005 for k in ("one", "two", "shift")) and np.array_equal(model.p["one"][rest], before["one"][rest])
    alike = attention.Trainer(model).gradients(at[:1], np.full(n, 7), np.full(n, 7), target)  # one id everywhere
    assert alike["one"][0].tolist() == [7] and np.allclose(alike["one"][1], alike["two"][1])


def test_quality_slope_equals_differences():
    """Documents of 2 and 40 lines and others, with weights of their own."""
    rng = np.random.default_rng(7)
    lines = np.array([2, 40, 1, 5, 9])
    doc = np.repeat(np.arange(5), lines)
    x, y, weight = rng.standard_normal((len(doc), 3)), np.array([0, 1, 1, 0, 1]), rng.random(5)
    theta = rng.standard_normal(10) * 0.5
    _, g = quality_crf.loss(theta, x, doc, y, weight)
    for k in range(len(theta)):
        e = np.zeros(len(theta))
        e[k] = 1e-5
        slope = (quality_crf.loss(theta + e, x, doc, y, weight)[0] - quality_crf.loss(theta - e, x, doc, y, weight)[0]) / 2e-5
        assert abs(slope - g[k]) < 1e-6 * max(1, abs(slope))


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    model = attention.Attention.fresh(9, 5, 4, seed=3)
    spans, one, two, target = np.array([0, 7, 12]), rng.integers(0, 9, 12), rng.integers(0, 9, 12), rng.integers(0, 5, 12)
    at = attention.windows(spans, 4)
    loss = lambda: -np.mean([x for x in plain_log_probabilities(model, one, two, spans, target, np.zeros(5))]) - math.log(1 / (1 - attention.FLOOR))
    found = attention.Trainer(model).gradients(at, one, two, target)
    for name in ("q", "k", "v", "out", "shift", "bias", "one", "two"):
        rows, g = found[name] if isinstance(found[name], tuple) else (np.arange(len(model.p[name])), found[name])
        i = int(rng.integers(len(rows)))
        place = (rows[i], 1) if model.p[name].ndim > 1 else (rows[i],)
        old = model.p[name][place]
        model.p[name] = model.p[name].astype(np.float64)
        ends = []
        for d in (1e-3, -1e-3):
            model.p[name][place] = old + d
            ends.append(loss())
        model.p[name][place] = old
        assert abs((ends[0] - ends[1]) / 2e-3 - g[(i, *place[1:])]) < 2e-3, name


def test_a_text_scores_as_the_sum_of_its_ids(spark):
    """The model's score of whole texts against a plain walk over their words and ids."""
    texts = [t for _, t in labelled(60)] + ["", "one", "the river ran"]
    n_ids = lm_scoring._pieces(PATH).get_piece_size()
    ones = np.ones(n_ids)
    model = lm_scoring.SubwordModel(PATH, texts, ones, ones, 50, 9, steps=20)
    model.prepare()
    raw = [t.encode() for t in texts]
    got = model.log10(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for k in (0, 1, 30, 60, 61, 62):
        spelled = [lm_scoring._pieces(PATH).encode(w) for w in brute.words(texts[k])]
        one, two = np.array([model.bos, *(s[0] for s in spelled)]), np.array([model.bos, *(s[-1] for s in spelled)])
        target = np.array([*(model.word_class[s[0]] for s in spelled), lm_scoring.WORD_CLASSES])
        total = sum(plain_log_probabilities(model.by_word, one, two, [0, len(one)], target, model.word_share))
        for s in spelled:
            s = np.array(s)
            inner = np.array([*model.piece_class[s[1:]], lm_scoring.PIECE_CLASSES])
            total += model.word_in[s[0]] + sum(plain_log_probabilities(model.by_piece, s, np.full(len(s), model.bos), [0, len(s)], inner, model.piece_share)) + model.piece_in[s[1:]].sum()
        assert abs(got[k] - total / math.log(10)) < 1e-3 * max(1, abs(got[k]))


def test_rounds_train_on_groups_whatever_the_partitions(spark):
    rows = [(i, t) for i, t in labelled(300) if i % 2]
    n_ids = lm_scoring._pieces(PATH).get_piece_size()
    data = [t.encode() for _, t in rows]
    whole = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in data])])

    def score(m):
        m.prepare()
        return m.log10(*whole)

    seen = []
    for parts in (1, 4, 70):
        model = lm_scoring.SubwordModel(PATH, [rows[0][1]], np.ones(n_ids), np.ones(n_ids), 50, 9, steps=5)
        before = score(model)
        seen.append(score(lm_scoring.trained_round(model, brute.docs(spark, rows).select("text").repartition(parts), 1.0, 0, groups=5)))
        assert seen[-1].sum() > before.sum()
    assert all(np.array_equal(x, seen[0]) for x in seen)


def test_drawn_windows_are_those_of_the_texts(spark):
    """All windows, with the words that they look at, against plain slices; and a share of them, the same for any partitioning."""
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 15, 16, 17, 31, 32, 33, 40)]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted((r.place, r.ended, r.text.decode()) for r in lm_scoring.drawn_windows(table, 1.0, 0, 3).collect())
    want = []
    for t in texts:
        w = t.split()
        for k in range(len(w) // 16 + 1):
            want.append((k, 16 * (k + 1) > len(w), " ".join(w[max(0, 16 * k - 17) : 16 * k + 16])))
    assert got == sorted(want)
    some = [sorted(tuple(r) for r in lm_scoring.drawn_windows(brute.docs(spark, labelled(80)).repartition(p), 0.3, 1, 4).collect()) for p in (1, 6)]
    assert some[0] == some[1] and 0.2 < len(some[0]) / lm_scoring.drawn_windows(brute.docs(spark, labelled(80)), 1.0, 1, 4).count() < 0.4


def test_windows_are_trained_on_as_whole_sequences(spark):
    """The step over a text's windows is that over the text as one sequence."""
    text = " ".join(f"and the w{k % 5}" for k in range(14))
    n_ids = lm_scoring._pieces(PATH).get_piece_size()
    model = lm_scoring.SubwordModel(PATH, [text], np.ones(n_ids), np.ones(n_ids), 50, 9, steps=3)
    rows = sorted(lm_scoring.drawn_windows(spark.createDataFrame([(text,)], "text string"), 1.0, 0, 1).collect(), key=lambda r: r.place)
    seen = []

    class Spy:
        def step(self, at, one, two, target, rate):
            real = at >= 0
            seen.append([([(int(one[i]), int(two[i])) for i in a[r]], target[a[16:][r[16:]]].tolist()) for a, r in zip(at, real)])

    model.train_on((Spy(), Spy()), np.array([r.place for r in rows]), np.array([r.ended for r in rows]), [bytes(r.text) for r in rows], np.random.default_rng(0))
    spelled = [lm_scoring._pieces(PATH).encode(w) for w in text.split()]
    one, two, _, target = model.word_sequences(np.array([x[0] for x in spelled]), np.array([x[-1] for x in spelled]), np.array([len(spelled)]))
    want = [(list(zip(one[max(0, lo - 16) : lo + 16].tolist(), two[max(0, lo - 16) : lo + 16].tolist())), target[lo : lo + 16].tolist()) for lo in range(0, len(one), 16)]
    assert sorted(seen[-1]) == sorted(want)


def test_gradient_is_causal():
    model = attention.Attention.fresh(9, 4, 4, seed=1)
    one, two, spans, share = np.arange(8) % 8, np.full(8, 8), np.array([0, 8]), np.full(4, 0.25)
    a = model.log_probabilities(model.tables(), one, two, spans, np.zeros(8, int), share)
    changed = one.copy()
    changed[5:] = 0
    b = model.log_probabilities(model.tables(), changed, two, spans, np.zeros(8, int), share)
    assert np.allclose(a[:5], b[:5]) and not np.allclose(a[5:], b[5:])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_scores_are_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = lm_scoring.lm_scores(docs, PATH, crc32_of_id("doc_id") % 10 == 0).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


@pytest.mark.parametrize("frequent", [10, 300_000])
def test_base_scores(spark, frequent):
    rows = [*labelled(60), *brute.AWKWARD]
    out = lm_scoring.lm_scores(brute.docs(spark, rows), PATH, crc32_of_id("doc_id") % 10 == 0, frequent=frequent, steps=50, rounds=1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*brute.words(t), None]) for i, t in rows]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = [(repr(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens]
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_scores_prefer_the_language_learnt(spark):
    rows = [(i, t) for i, t in labelled(200) if i % 2]
    shuffled = "zq xv qqj wvx jjq kxz vvq zzx qjx"
    out = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.lm_scores(brute.docs(spark, [*rows, (1000, rows[0][1]), (1001, shuffled)]), PATH, F.col("doc_id") >= 1000).collect()}
    assert out[1000] > out[1001] + 0.5


def test_lm_without_training_rows(spark):
    out = lm_scoring.lm_scores(brute.docs(spark, [(1, "a b"), (2, None)]), PATH, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in out) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm_scoring.lm_scores(brute.empty(spark), PATH, F.lit(False)).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = labelled(200)
    docs = brute.docs(spark, rows + brute.AWKWARD)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:120]], "doc_id long, toxic int")
    model = mixing.train(docs, labels, ("toxic",))
    rated, target, got = mixing.mix(docs, model, {"toxic1": 0.8, "toxic0": 0.2}, anchor="toxic1")
    out = rated.collect()
    assert len(out) == len(rows) + len(brute.AWKWARD) and all(r.rate >= 0 for r in out) and set(out[0].row.asDict()) == set(docs.columns) - {"text"}
    total = np.sum([[r.rate * r.n_tokens * p for p in r.posterior] for r in out], axis=0)
    tokens = sum(r.n_tokens for r in out)
    for k, name in enumerate(model.names):
        assert abs(total[k] - target[name]) <= 2e-3 * tokens and math.isclose(total[k], got[name], rel_tol=1e-6)
    assert mixing.mix(docs.limit(0), model, {"toxic1": 1.0}, anchor="toxic1")[0].count() == 0
    one = mixing.train(docs, labels.limit(0), ("toxic",))
    assert {r.rate for r in mixing.mix(docs, one, {"all": 1.0}, anchor="all")[0].collect()} == {1.0}


def test_rates_equal_a_plain_solver(spark):
    """The fitted rates against projected gradient steps in plain loops over the same posteriors, and the totals against the optimum."""
    rows = labelled(120, seed=9)
    docs = brute.docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows[:80]], "doc_id long, toxic int")
    model = mixing.train(docs, labels, ("toxic",))
    rated, target, got = mixing.mix(docs, model, {"toxic1": 0.7, "toxic0": 0.3}, anchor="toxic1", close=1e-6)
    out = rated.collect()
    n, p, t = [r.n_tokens for r in out], [list(r.posterior) for r in out], [target[name] for name in model.names]
    rates = [1.0] * len(n)
    tokens = sum(n)
    start = [sum(a * b[k] for a, b in zip(n, p)) for k in range(2)]
    scale = [max(s, 1e-3 * tokens) for s in start]
    for _ in range(mixing.STEPS):
        off = [sum(r * a * b[k] for r, a, b in zip(rates, n, p)) - t[k] for k in range(2)]
        if max(map(abs, off)) <= 1e-6 * tokens:
            break
        m = [[sum(a * b[i] * b[j] for r, a, b in zip(rates, n, p) if r > 0) / math.sqrt(scale[i] * scale[j]) for j in range(2)] for i in range(2)]
        top = (m[0][0] + m[1][1] + math.sqrt((m[0][0] - m[1][1]) ** 2 + 4 * m[0][1] * m[1][0])) / 2
        rates = [max(0.0, r - sum(b[k] * off[k] / scale[k] for k in range(2)) / top) for r, b in zip(rates, p)]
    assert max(abs(r.rate - x) for r, x in zip(out, rates)) < 1e-6
    best = [sum(x * a * b[k] for x, a, b in zip(rates, n, p)) for k in range(2)]
    assert all(abs(best[k] - got[name]) < 1e-6 * tokens and abs(best[k] - t[k]) < 2e-3 * tokens for k, name in enumerate(model.names))


def test_copies(spark):
    rates = spark.range(4000).select("id", (F.col("id") % 3 / 2).alias("rate"))
    total = rates.agg(F.sum(mixing.copies(F.col("rate"), F.col("id"))).alias("n"), F.sum("rate").alias("want")).first()
    assert abs(total.n - total.want) < 0.05 * total.want
    assert rates.where("id = 1").select(mixing.copies(F.col("rate"), F.col("id"), nearest=True)).first()[0] == 1


def test_rounds_take_each_window_and_each_word_once(spark):
    rows = [*labelled(60), (100, ""), (101, "the " * 700)]
    train = spark.createDataFrame(rows, "id long, text string").repartition(3)
    whole = sorted((r.key, r.place) for r in lm_scoring.drawn_windows(train, 1.0, 0, 3).collect())
    spelled = lm_scoring.spelled_texts(train, PATH)
    for table in (train, spelled):
        rounds = [[(r.key, r.place) for r in lm_scoring.drawn_windows(table, 1 / 3, k, 3).collect()] for k in range(3)]
        seen = sorted(x for r in rounds for x in r)
        assert all(rounds) and len(seen) == len(whole) and (table is spelled or seen == whole)
    counts = lm_scoring.word_counts(train, "id", "text")
    found = Counter()
    for k in range(3):
        for r in lm_scoring.drawn_words(counts, 1 / 3, k).collect():
            assert r.weight <= lm_scoring.COPY
            found[r.word] += r.weight
    assert {w: round(c, 6) for w, c in found.items()} == Counter(w for _, t in rows for w in brute.words(t))


def test_classes_and_weights_follow_all_training_texts(spark):
    """Pairs of neighbouring ids of every text, in small flushes, against plain loops; and a trained window comes from spelled ids as from words."""
    rows = [*labelled(40), (100, ""), (101, None), (102, "unbelievable antidisestablishmentarianism " * 40)]
    train = spark.createDataFrame(rows, "id long, text string").repartition(3)
    n_ids = lm_scoring._pieces(PATH).get_piece_size()
    spelled = lm_scoring.spelled_texts(train, PATH)
    counts = lm_scoring.word_counts(train, "id", "text")
    begins, inner, ends, within = lm_scoring.piece_counts(counts, PATH, n_ids)
    want_word, want_piece, want_begins = Counter(), Counter(), Counter()
    for _, t in rows:
        ids = [lm_scoring._pieces(PATH).encode(w) for w in brute.words(t)]
        want_begins.update(x[0] for x in ids)
        want_word.update((a[0], b[0]) for a, b in zip(ids, ids[1:]))
        want_piece.update(p for x in ids for p in zip(x, x[1:]))
    assert {i: int(begins[i]) for i in np.flatnonzero(begins)} == want_begins
    for pairs, want in ((lm_scoring.word_pairs(spelled, n_ids), want_word), (within, want_piece)):
        got = Counter()
        for r in pairs.collect():
            for key, n in zip(np.frombuffer(r.keys, "<i8").tolist(), np.frombuffer(r.times, "<i8").tolist()):
                got[divmod(key, n_ids)] += n
        assert got == want
        slot = attention.most_frequent(np.bincount([a for a, _ in want.elements()], minlength=n_ids), 4)
        cells = Counter()
        for (a, b), n in want.items():
            if slot[b] >= 0:
                cells[a * 8 + int(slot[b])] += n
            if slot[a] >= 0:
                cells[b * 8 + int(slot[a]) + 4] += n
        assert dict(zip(*(x.tolist() for x in lm_scoring.neighbours(pairs, slot)))) == cells


def test_kept_words_have_their_values_and_those_met_again_stay(monkeypatch):
    monkeypatch.setattr(lm_scoring, "MOST_SPELLED", 60)
    rng, kept, made = np.random.default_rng(3), lm_scoring.Kept(), []

    for k in range(200):
        h = np.unique(np.concatenate([np.arange(10), rng.integers(10, 5000, 25)])).astype(np.uint64)  # ten words in every call

        def make(lack, h=h):
            made.extend(h[lack].tolist())
            return h[lack] * np.uint64(3), h[lack].astype(float) / 2

        a, b = kept.values(h, make)
        assert np.array_equal(a, h * np.uint64(3)) and np.array_equal(b, h / 2) and len(kept.rows[0]) <= 100
    assert max(Counter(made)[i] for i in range(10)) == 1


def test_a_worker_spells_half_a_million_words_once():
    kept, made = lm_scoring.Kept(), []

    def make(lack):
        made.append(len(lack))
        return (lack,)

    for _ in range(2):
        for lo in range(0, 500_000, 50_000):
            kept.values(np.arange(lo, lo + 50_000, dtype=np.uint64), make)
    assert sum(made) == 500_000

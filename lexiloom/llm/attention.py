"""A one-head causal self-attention model over classes of subword ids, in numpy: training by Adam, scoring in overlapping windows.

A sequence of inputs is cut into blocks. A block's inputs attend to themselves and to the block before, as far as these lie in the
same sequence and not later: windows of two blocks overlap by one, and each target is scored once, with one block of context at
least where the sequence has it. The logits of the next id's class are mixed with the classes' shares in the whole corpus, and an
id's share in its class is a corpus count too, so that what training never saw keeps some probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 16
#: Weight of the corpus shares beside the model's class probabilities.
FLOOR = 0.01
#: Inputs whose attention is worked out together when they are scored.
TOGETHER = 2048
#: Logits worked out together, so that they stay in a core's cache.
LOGITS = 1 << 16
#: Logits within this of zero need no shift before they are exponentiated, nor where they are then multiplied by as much.
SAFE = 40


def windows(offsets: np.ndarray, block: int):
    """For sequences laid end to end: the inputs (blocks, 2 * block) of each window, -1 where it has none; the window's own
    block comes second."""
    size = np.diff(offsets)
    blocks = -(-size // block)
    of = np.repeat(np.arange(len(size)), blocks)
    k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = (k * block - block)[:, None] + np.arange(2 * block)
    inside = (at >= 0) & (at < size[of][:, None])
    return np.where(inside, offsets[:-1][of][:, None] + at, -1)


def blocks(offsets: np.ndarray, block: int):
    """The inputs (blocks, block) of each window's own block, -1 behind a sequence's end; and whether the block begins a sequence."""
    size = np.diff(offsets)
    many = -(-size // block)
    of = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    at = (k * block)[:, None] + np.arange(block)
    return np.where(at < size[of][:, None], offsets[:-1][of][:, None] + at, -1), k == 0


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of logits in place, shifted by row where they are large, and its sums by row."""
    if z.size and not -SAFE < z.min() <= z.max() < SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def logits(classes: int) -> np.ndarray:
    """Room for the logits of some targets."""
    return np.empty((max(64, LOGITS // classes), classes), np.float32)


def stretches(n: int, room: np.ndarray):
    return (slice(lo, lo + len(room)) for lo in range(0, n, len(room)))


def most_frequent(count: np.ndarray, features: int = 512) -> np.ndarray:
    """Of each id its place among the most frequent, -1 for all others."""
    slot = np.full(len(count), -1)
    slot[np.argsort(-count, kind="stable")[:features]] = np.arange(min(features, len(count)))
    return slot


def company(left: np.ndarray, right: np.ndarray, slot: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often ids stand before and behind the most frequent ones: cells (id, which side and place) and their counts."""
    width = 2 * (int(slot.max(initial=0)) + 1)
    cells, many = [], []
    for a, b, shift in ((left, right, 0), (right, left, width // 2)):
        told = np.flatnonzero(slot[b] >= 0)
        cells.append(a[told] * width + slot[b[told]] + shift)
        many.append(times[told])
    return summed(np.concatenate(cells), np.concatenate(many))


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of what they stand beside."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def cluster(cells: np.ndarray, times: np.ndarray, count: np.ndarray, classes: int, slot: np.ndarray, seed: int = 0) -> np.ndarray:
    """Classes of ids by the company they keep (cells and times), each counted so often: k-means over co-occurrence with the most
    frequent ids; ids without count share the last class."""
    width = 2 * (int(slot.max(initial=0)) + 1)
    seen = np.flatnonzero(count)
    out = np.full(len(count), classes - 1)
    if len(seen) == 0:
        return out
    row = np.full(len(count), -1)
    row[seen] = np.arange(len(seen))
    table = np.zeros((len(seen), width), dtype=np.float32)
    table[row[cells // width], cells % width] = times
    across, down, whole = table.sum(axis=0, keepdims=True), table.sum(axis=1, keepdims=True), max(table.sum(), 1)
    for lo in range(0, len(table), 1024):  # in place, as it may have a row for each id
        expect = across * down[lo : lo + 1024] / whole
        table[lo : lo + 1024] = np.sqrt(np.maximum(np.log((table[lo : lo + 1024] + 0.1) / (expect + 0.1)), 0))
    rng = np.random.default_rng(seed)
    weight = count[seen].astype(np.float64)
    basis = np.linalg.qr(table.T @ (table @ rng.standard_normal((table.shape[1], 24)).astype(np.float32)))[0]
    x = table @ basis
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    k = min(classes - 1, len(seen))
    centre = x[rng.choice(len(seen), k, replace=False, p=weight / weight.sum())]
    for _ in range(25):
        mine = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, mine, x * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre)
    out[seen] = np.argmax(x @ centre.T, axis=1)
    return out


@dataclass
class Attention:
    """p: one, two (embeddings of an input's two ids), q, k, v, bias (block, 2 * block), out, shift."""

    block: int
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, n_ids: int, classes: int, block: int, seed: int = 0) -> Attention:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        p = {"one": make(n_ids, WIDTH), "two": make(n_ids, WIDTH), "q": make(WIDTH, WIDTH), "k": make(WIDTH, WIDTH), "v": make(WIDTH, WIDTH), "bias": np.zeros((block, 2 * block), np.float32), "out": make(WIDTH, classes), "shift": np.zeros(classes, np.float32)}
        return cls(block, p)

    def _attend(self, s: np.ndarray) -> None:
        """Attention weights, not yet divided by their sums, in place of the products of queries (over the root of the width) and keys."""
        s += self.p["bias"]
        seen = (np.arange(2 * self.block) <= np.arange(self.block)[:, None] + self.block).astype(np.float32)
        if s.size and not -SAFE < s.min() <= s.max() < SAFE:
            s += np.where(seen > 0, np.float32(0), np.float32(-1e9))
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s *= seen

    def _parts(self) -> np.ndarray:
        """One array for queries (over the root of the width), keys and values."""
        return np.concatenate([self.p["q"] * np.float32(WIDTH**-0.5), self.p["k"], self.p["v"]], axis=1)

    def tables(self):
        """What scoring looks up: the embeddings of an input's two ids, _parts, the output's table, exp of its shift, and a bound of its columns' norms
        (none where the shift is too large to be left out of the exponent)."""
        calm = np.abs(self.p["shift"]).max() < SAFE
        steep = float(np.linalg.norm(self.p["out"], axis=0).max()) if calm else np.inf
        odds = np.exp(self.p["shift"]) if calm else np.ones_like(self.p["shift"])
        return [*(np.ascontiguousarray(self.p[k]) for k in ("one", "two")), self._parts(), np.ascontiguousarray(self.p["out"]), odds, steep]

    def log_probabilities(self, tables, one, two, offsets, target, share) -> np.ndarray:
        """Natural log probability of each input's target class."""
        out = np.zeros(len(one))
        if not len(one):
            return out
        by_one, by_two, parts, ahead, odds, steep = tables
        own_of, begins = blocks(offsets, self.block)
        b, w, same = self.block, WIDTH, by_two[two[0]] if (two == two[0]).all() else None
        together, ones, room = max(1, TOGETHER // b), np.ones(2 * b, np.float32), logits(len(odds))
        for lo in range(0, len(own_of), together):
            at = own_of[max(lo - 1, 0) : lo + together]  # with the block before, which the first one looks at
            mine, safe = own_of[lo : lo + together], np.maximum(at.ravel(), 0)  # nothing looks at what stands behind a sequence's end
            n = len(mine)
            e = np.zeros(((n + 1) * b, w), np.float32)
            np.add(by_one.take(one[safe], axis=0), by_two.take(two[safe], axis=0) if same is None else same, out=e[-len(safe) :])
            f = e @ parts
            far, near = f.strides
            key, value = (np.ndarray((n, 2 * b, w), f.dtype, f, x * near, (b * far, far, near)) for x in (w, 2 * w))  # each block with the one before
            s = np.matmul(f[b:, :w].reshape(n, b, w), key.transpose(0, 2, 1))
            self._attend(s)
            s[begins[lo : lo + together], :, :b] = 0
            h = np.matmul(s, value).reshape(-1, w)
            h /= (s.reshape(-1, 2 * b) @ ones)[:, None]
            h += e[b:]
            mine = mine.ravel()
            real = np.flatnonzero(mine >= 0)
            if len(real) < len(mine):
                h, mine = h[real], mine[real]
            want, calm = target[mine], steep * float(np.einsum("ij,ij->i", h, h).max()) ** 0.5 < SAFE
            for some in stretches(len(h), room):
                z, which = np.matmul(h[some], ahead, out=room[: len(h[some])]), want[some]
                if calm:
                    np.exp(z, out=z)
                    each = z[np.arange(len(z)), which].astype(np.float64) * odds[which] / (z @ odds)
                else:
                    z += self.p["shift"]
                    z, total = exponentials(z)
                    each = z[np.arange(len(z)), which] / total.astype(np.float64)
                out[mine[some]] = (1 - FLOOR) * each + FLOOR * share[which]
        return np.log(out, out=out)

    def train(self, one, two, offsets, target, steps: int = 400, batch: int = 48, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over windows drawn at random, the rate falling to a tenth."""
        at_all = windows(offsets, self.block)
        if not len(at_all):
            return
        rng, steady = np.random.default_rng(seed), Trainer(self)
        batch = batch * max(1, 16 // self.block)
        for t in range(1, steps + 1):
            steady.step(at_all[rng.integers(0, len(at_all), batch)], one, two, target, rate * min(1.0, t / 20) * (1 - 0.9 * t / steps))


class Trainer:
    """Adam's state for one model: steps over given windows, and how many windows were in the steps that touched each row."""

    def __init__(self, model: Attention):
        """The model's arrays become views of what is kept here: a row of each table of ids beside its two means, and all other arrays end to end."""
        self.model, self.t, self.seen = model, 0, 0
        self.touched, self.rows = {}, {}
        for k in ("one", "two"):
            self.touched[k] = np.zeros(len(model.p[k]), np.int64)
            self.rows[k] = np.zeros((len(model.p[k]), 3 * WIDTH), np.float32)
            self.rows[k][:, :WIDTH] = model.p[k]
            model.p[k] = self.rows[k][:, :WIDTH]
        self.flat = np.concatenate([model.p[k].ravel() for k in self.DENSE])
        self.m1, self.m2, lo = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        for k in self.DENSE:
            old = model.p[k]
            model.p[k] = self.flat[lo : lo + old.size].reshape(old.shape)
            lo += old.size
        self.room = logits(len(old))

    #: In this order; out and shift come last.
    DENSE = ("bias", "q", "k", "v", "out", "shift")

    def _met(self, name: str, ids: np.ndarray, inside: np.ndarray | None):
        """The rows met, their values by place in the windows (0 where these hold nothing; one row if all second ids are alike), and a
        function that sums gradients by row."""
        table = self.model.p[name]
        if (ids == ids[0]).all():
            return ids[:1], table[np.broadcast_to(ids[:1], len(ids) if name == "one" else 1)], lambda de: de.sum(axis=0, keepdims=True)
        if inside is not None:
            ids = np.where(inside, ids, len(table))
        order = np.argsort(ids.astype(np.uint16 if len(table) < 1 << 16 else np.int64), kind="stable")  # short numbers sort faster
        ordered = ids[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        starts, place = np.flatnonzero(new), np.empty(len(ids), np.int64)
        place[order] = np.cumsum(new) - 1
        rows = ordered[starts]
        n = len(rows) - (rows[-1] == len(table))
        values = np.zeros((len(rows), WIDTH), np.float32)
        values[:n] = table[rows[:n]]
        return rows[:n], values.take(place, axis=0), lambda de: np.add.reduceat(de.take(order, axis=0), starts, axis=0)[:n]

    def gradients(self, at, one, two, target, weight=None) -> dict:
        """Of the mean log loss over the windows' targets, each weighted (once, if not told); for the tables of ids the rows met and
        their gradients."""
        b, w, n, parts = self.model.block, WIDTH, len(at), self.model._parts()
        inside, safe = at >= 0, np.maximum(at, 0).ravel()
        lacks = None if inside.all() else inside.ravel()
        (rows_one, e, sum_one), (rows_two, more, sum_two) = self._met("one", one[safe], lacks), self._met("two", two[safe], lacks)
        e += more
        f = (e @ parts).reshape(n, 2 * b, 3 * w)
        q, k, v = f[:, b:, :w], f[:, :, w : 2 * w], f[:, :, 2 * w :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        self.model._attend(s)
        if lacks is not None:
            s *= inside.astype(np.float32)[:, None, :]
        s /= (s.reshape(-1, 2 * b) @ np.ones(2 * b, np.float32)).reshape(n, b, 1)
        seen = np.matmul(s, v).reshape(-1, w)
        own = at[:, b:].ravel()
        r = np.flatnonzero(own >= 0)
        told = np.ones((n * b, w + 1), np.float32)  # the last column is the shift's
        np.add(seen, e.reshape(n, 2 * b, w)[:, b:].reshape(-1, w), out=told[:, :w])
        told, want = told[r], target[own[r]]
        h, out, shift = told[:, :w], self.model.p["out"], self.model.p["shift"]
        dh, g_ahead = np.zeros_like(seen), np.zeros((len(shift), w + 1), np.float32)
        # where logits are small, exp of the shift is left out of them and multiplies the classes' columns
        calm = np.abs(shift).max() < SAFE and (np.einsum("ij,ij->i", h, h).max(initial=0) * np.einsum("ij,ij->j", out, out).max()) ** 0.5 < SAFE
        odds = np.exp(shift) if calm else np.ones(len(shift), np.float32)
        share = np.full(len(r), 1 / max(len(r), 1), np.float32) if weight is None else (weight[r // b] / max(len(r), 1)).astype(np.float32)
        back = (out * odds).T
        for some in stretches(len(r), self.room):
            which = want[some]
            z = np.matmul(h[some], out, out=self.room[: len(which)])
            if calm:
                np.exp(z, out=z)
                total = z @ odds
            else:
                z += shift
                z, total = exponentials(z)
            # a target's share of the loss over its sum of exponentials: rows are multiplied by it after they have met the output's table
            each = (share[some] / total)[:, None]
            z[np.arange(len(z)), which] -= total / odds[which]
            dh[r[some]] = z @ back * each
            g_ahead += z.T @ (told[some] * each)
        g_ahead *= odds[:, None]
        dh = dh.reshape(n, b, w)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", dh.reshape(-1, w), seen).reshape(n, b, 1)
        ds *= s
        df = np.zeros_like(f)
        df[:, b:, :w] = np.matmul(ds, k)
        df[:, :, w : 2 * w] = np.matmul(ds.transpose(0, 2, 1), q)
        df[:, :, 2 * w :] = np.matmul(s.transpose(0, 2, 1), dh)
        df = df.reshape(-1, 3 * w)
        g_parts, de = e.T @ df, df @ parts.T
        de.reshape(n, 2 * b, w)[:, b:] += dh
        return {
            "bias": ds.sum(axis=0), "q": g_parts[:, :w] * np.float32(w**-0.5), "k": g_parts[:, w : 2 * w], "v": g_parts[:, 2 * w :], "out": g_ahead[:, :w].T, "shift": g_ahead[:, w],
            "one": (rows_one, sum_one(de)), "two": (rows_two, sum_two(de)),
        }

    def step(self, at, one, two, target, rate: float, weight=None) -> None:
        self.t, self.seen = self.t + 1, self.seen + len(at)
        found, fast, slow = self.gradients(at, one, two, target, weight), np.float32(rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.99**self.t))

        def moved(p, m1, m2, grad):
            m1 *= np.float32(0.9)
            m1 += np.float32(0.1) * grad
            m2 *= np.float32(0.99)
            grad = grad * grad
            grad *= np.float32(0.01)
            m2 += grad
            np.multiply(m2, slow, out=grad)
            np.sqrt(grad, out=grad)
            grad += np.float32(1e-8)
            np.divide(m1, grad, out=grad)
            grad *= fast
            p -= grad

        moved(self.flat, self.m1, self.m2, np.concatenate([found[k].ravel() for k in self.DENSE]))
        for name, table in self.rows.items():
            rows, grad = found[name]
            self.touched[name][rows] += len(at)
            part = np.ascontiguousarray(table.take(rows, axis=0).reshape(-1, 3, WIDTH).transpose(1, 0, 2))
            moved(*part, grad)
            table[rows] = part.transpose(1, 0, 2).reshape(-1, 3 * WIDTH)

    def changes(self):
        """(name, rows, windows, values) of what was trained: rows of the tables of ids that were touched, other arrays row by row."""
        for name, value in self.model.p.items():
            flat = value.reshape(len(value), -1) if value.ndim > 1 else value[None]
            steps = self.touched.get(name, np.full(len(flat), self.seen))
            rows = np.flatnonzero(steps)
            if len(rows):
                yield name, rows, steps[rows], flat[rows]

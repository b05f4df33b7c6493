import random

import numpy as np
import pytest

from lexiloom.llm import near_dup
from lexiloom.llm.components import components

from . import brute


def check(spark, rows, **what):
    got = near_dup.near_duplicates(brute.docs(spark, rows), **what).collect()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(brute.shingles(t))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    want = brute.components(ids, links)
    assert sorted((repr(i), len(brute.shingles(t)), want.get(i), i is None or want[i] == i) for i, t in rows) == sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got)
    return want


def test_awkward_rows(spark):
    want = check(spark, brute.AWKWARD)
    assert want[2] == 1 and want[3] == 1 and want[8] == 7 and want[9] == 9


def test_empty_table(spark):
    assert near_dup.near_duplicates(brute.empty(spark)).count() == 0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("short_list", [64, 4])
def test_copies_of_a_base_and_a_shared_passage(spark, short_list):
    """Copies near the base and not each other, a passage that many documents share, chains; also with lists treated as long."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = [(1000, " ".join(base))] + [(k, " ".join(edited(rng, base, rng.randrange(4)))) for k in range(40)]
    rows += [(100 + k, " ".join([word() for _ in range(80)] + passage + [word() for _ in range(60)])) for k in range(40)]
    text = [word() for _ in range(100)]
    for k in range(10):
        rows.append((200 + k, " ".join(text)))
        text = edited(rng, text, 2)
    rows += [(300 + k, " ".join(word() for _ in range(60))) for k in range(30)]
    check(spark, rows, short_list=short_list)


def test_long_lists_are_compared_beyond_their_hubs(spark, monkeypatch):
    """Copies of a text that lack three of its sections each and one word more: near those that lack the same, and few hubs are."""
    monkeypatch.setattr(near_dup, "BLOCK", 300)
    rng = random.Random(9)
    sections = [[f"w{s}x{k}" for k in range(10)] for s in range(16)]
    rows = []
    for group in range(16):
        lacks = rng.sample(range(16), 3)
        text = [w for s, words in enumerate(sections) if s not in lacks for w in words]
        rows += [(100 * group + k, " ".join(edited(rng, text, 1))) for k in range(60)]
    rng.shuffle(rows)
    check(spark, rows, short_list=8, k=16)


@pytest.mark.parametrize(("n", "sites", "block"), [(300, 16, 1024), (400, 20, 100)])
def test_template_families(spark, monkeypatch, n, sites, block):
    """Texts of fixed sites, each with one of two words: most pairs are alike enough to be candidates, few are links."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(n)
    site = lambda s: " ".join([*(f"f{s}w{k}" for k in range(7)), f"v{s}{rng.choice('ab')}"])
    want = check(spark, [(i, " ".join(site(s) for s in range(sites))) for i in range(n)])
    assert 1 < len(set(want.values())) < n // 10


def test_shared_counts_in_chunks(monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    sets = [set(rng.integers(0, 60, rng.integers(0, 40)).tolist()) for _ in range(25)]
    outside = rng.random(25) < 0.4
    got = near_dup._shared_counts(np.array([v for s in sets for v in sorted(s)]), np.array([len(s) for s in sets]), outside)
    assert got.tolist() == [[len(sets[i] & sets[j]) for j in np.flatnonzero(~outside)] for i in np.flatnonzero(outside)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute.components(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

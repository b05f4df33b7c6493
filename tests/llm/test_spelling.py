import random
import re
import zlib
from collections import Counter

import pytest

from lexiloom.llm import spelling as S

from . import brute


def plain_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v)) if close else None
        out[w] = [n, len(close), best if best and words[best] >= 2 * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [words.get(row[2]), root]
    return {w: tuple(r) for w, r in out.items()}


def got(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def family_rows(seed):
    """Texts over few letters, so that words have many near ones, with counts far apart; a prefix that many words share; long runs."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((5, 6, 7)))) for _ in range(160)}
    words |= {"prefix" + "".join(rng.choice("xyz") for _ in range(rng.choice((0, 1, 2, 3, 4)))) for _ in range(60)}
    words |= {"".join(rng.choice("mn") for _ in range(3)) + "suffix" for _ in range(20)} | {"q" * 70, "q" * 71, "q" * 60 + "r" + "q" * 9}
    rows = []
    for k, w in enumerate(sorted(words)):
        for _ in range(rng.choice((1, 3, 4, 9, 30))):
            rows.append((k % 37, f"{w.upper() if rng.random() < 0.2 else w} and{rng.choice(' ,9-')}{w}"))
    return rows


@pytest.mark.parametrize("most", [64, 3])
def test_variants_are_those_of_plain_loops(spark, monkeypatch, most):
    rows = family_rows(most)
    want = plain(plain_words(rows))
    assert sum(1 for r in want.values() if r[2]) > 30
    monkeypatch.setattr(S, "PAIRS", 500)
    assert {r.word: r.n for r in S.counted_words(brute.docs(spark, rows)).collect()} == {w: r[0] for w, r in want.items()}
    monkeypatch.setattr(S.near_words, "__defaults__", (S.LEAST_LENGTH, most))
    assert got(S.spelling_variants(brute.docs(spark, rows).repartition(3))) == want


def test_every_shift_of_an_edit_is_found_once(spark):
    """All words at one edit from a few words, one entry a word at most."""
    base = ["abcde", "abcdef", "aaaaa", "aaaaaa", "xyxyxyxy"]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + c + w[k:] for c in "axy"} | {w[:k] + c + w[k + 1 :] for c in "axy"} | {w[:k] + w[k + 1 :]}
    words = {w: 3 + len(w) * 7 % 5 for w in words if len(w) >= 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for most in (1, 8, 1000):
        found = {r.word: r.n_near for r in S.near_words(table, most=most).collect()}
        assert found == {w: k for w in words if (k := sum(near(w, v) for v in words))}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(21)] + [(f"v{k}", "w7") for k in range(9)]
    found = {r.word: r.root for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w21" for w, _ in chain}


def test_awkward_and_empty(spark):
    assert got(S.spelling_variants(brute.docs(spark))) == plain(plain_words(brute.AWKWARD))
    assert S.spelling_variants(brute.empty(spark)).collect() == []

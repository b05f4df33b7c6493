import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import xxhash

from lexiloom.llm import fingerprints as fp
from lexiloom.llm import url_filters

from . import brute


def test_edits_and_equal_texts(spark):
    out = fp.fingerprints(brute.docs(spark)).collect()
    assert len(out) == len(brute.AWKWARD)
    order = sorted({(i, t or "") for i, t in brute.AWKWARD}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()), reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    want = []
    for i, t in brute.AWKWARD:
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[i, t][1][:half]
        want.append((repr(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[7].fingerprint == by_id[8].fingerprint
    assert by_id[4].fingerprint == by_id[5].fingerprint == "" and by_id[4].near_edited == 1.0 and by_id[5].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fp.fingerprints(brute.empty(spark)).count() == 0


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(150):
        a = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([12, 60, 400]))]
        b = [w if rng.random() > 0.03 * (k % 5) else "new" for w in a]
        pairs.append((" ".join(a), " ".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    table = fp.with_fingerprint(fp.with_fingerprint(table, "a", "fa"), "b", "fb")
    off = []
    for r in table.select("a", "b", fp.likeness("fa", "fb").alias("y")).collect():
        x, y = brute.shingles(r.a), brute.shingles(r.b)
        off.append(r.y - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12


def plain_fingerprint(text):
    """Bins, walks to filled bins and low-order bits in plain loops."""
    w = brute.words(text)
    if len(w) >= fp.WIDTH:
        parts = [w[i : i + fp.WIDTH] for i in range(len(w) - fp.WIDTH + 1)]
    else:
        parts = [[" ".join(w)]] if w else []
    least = {}
    for part in parts:
        h = 42
        for word in part:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        h -= (h >> 63) << 64
        k = (h >> 64 - fp.BIN_BITS) + fp.BINS // 2
        least[k] = min(least.get(k, h), h)
    out = ""
    for k in range(fp.BINS if least else 0):
        a, b = fp._walk(k)
        at = k if k in least else min(least, key=lambda f: (f - b) * a % fp.BINS)
        out += f"{least[at] & 255:02x}"
    return out


def test_fingerprints_equal_plain_loops(spark):
    rng = random.Random(3)
    texts = ["", None, "one", "One two THREE four", "a b c d e", "ÄÖ ü 日本語 😀 é́ z", " ".join(f"w{rng.randrange(50)}" for _ in range(30)), " ".join(f"w{rng.randrange(9999)}" for _ in range(700)), "x" * 200_000, "word " * 50_000]
    got = fp.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t", "f").collect()
    assert {r.id: r.f for r in got} == {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    pairs = spark.createDataFrame([(plain_fingerprint(a), plain_fingerprint(b)) for a in texts[3:8] for b in texts[3:8]], "a string, b string")
    for r in pairs.select("a", "b", fp.likeness("a", "b").alias("y")).collect():
        m = sum(r.a[2 * i : 2 * i + 2] == r.b[2 * i : 2 * i + 2] for i in range(fp.BINS)) / fp.BINS
        assert abs(r.y - (1.0 if r.a == r.b else max(0.0, (m - 2**-8) / (1 - 2**-8)))) < 1e-9


def test_no_python_in_the_plan(spark):
    plan = fp.fingerprints(brute.docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_urls(spark):
    urls = [
        ("http://A.Example.com/en/1?x=/fr/", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://m.www.example.com/en/x", "m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        ("http://a.net/fr/#q", "a.net", "/fr/", "net/fr/", "block"), ("http://notnet/fr/", "notnet", "/fr/", None, "allow"),
        ("http://x.org/free-casino/", "x.org", "/free-casino/", None, "block"), ("http://x.org/free/", "x.org", "/free/", None, "allow"),
        ("http://x.org/?porn", "x.org", "/", None, "block"), ("http://x.org/pornography", "x.org", "/pornography", None, "allow"),
        ("no scheme xxx", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://com", "com", "", None, "allow"), ("a://b://c.net/es/", "b:", "//c.net/es/", None, "allow"),
    ]
    urls += [
        ("http://x.org/porn/free", "x.org", "/porn/free", None, "block"), ("http://x.org/casino", "x.org", "/casino", None, "allow"), ("http://x.org/free-download", "x.org", "/free-download", None, "allow"),
        ("http://x.org/poker/free", "x.org", "/poker/free", None, "block"), ("http://poker.x.org/POKER", "poker.x.org", "/POKER", None, "allow"), ("http://a.com/porn", "a.com", "/porn", "com/", "allow"),
        ("http://x.org/" + "y" * 100_000 + "/xxx", "x.org", "/" + "y" * 100_000 + "/xxx", None, "block"),
    ]
    table = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(table).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filters.url_verdicts(table.limit(0)).count() == 0
    # the SQL form decides alike, where the vocabulary does too
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([(i, u[0]) for i, u in enumerate(urls)], columns=["page_id", "url"]))
    cur = con.execute(url_filters.oracle())
    names = [d[0] for d in cur.description]
    want = {r["page_id"]: r for r in (dict(zip(names, row)) for row in cur.fetchall())}
    for r in url_filters.url_verdicts(table).collect():
        assert all(r[c] == want[r.page_id][c] for c in names), (r, want[r.page_id])


def test_vocabulary_as_a_table(spark):
    terms = url_filters.packaged_vocabulary()
    assert len({t.term for t in terms}) == len(terms) and {t.kind for t in terms} == {"strict", "soft"} and all(t.term.isalnum() and t.term.isascii() for t in terms)
    pages = spark.createDataFrame([(1, "http://x.org/apple"), (2, "http://x.org/pear-plum"), (3, "http://x.org/pear"), (4, "http://x.org/casino-poker")], "page_id long, url string")
    own = url_filters.vocabulary(spark.createDataFrame([("Apple", "strict", 2.0), ("pear", "soft", 1.0), ("plum", "soft", 2.0), ("", "soft", 9.0)], "term string, kind string, weight double"))
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(pages, rules=(), terms=own).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert {r.verdict for r in url_filters.url_verdicts(pages, rules=(), terms=()).collect()} == {"allow"}

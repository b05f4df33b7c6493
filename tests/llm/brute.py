"""Plain, slow versions of the operators' contracts, and awkward little tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old house on the hill today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old house on the hill today"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs away from the old house on the hill now"),
    (4, ""), (5, None), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "one two three"), (10, "ÄÖ ü 日本語 😀 é́ ▁ <s>"),
    (11, "x" * 5000), (12, "word " * 3000), (13, "a\nb\n\nc|d|e\n!!!"), (None, "no id here at all but text"), (14, "same again and again and again and again"), (14, "same again and again and again and again"),
]


def docs(spark, rows=AWKWARD):
    """doc_id, text, and columns whose names clash with what operators use inside."""
    table = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1.5, "y") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, sketch string")


def empty(spark):
    return docs(spark).limit(0)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}

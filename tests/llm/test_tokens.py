import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from lexiloom.llm import sentencepiece_codec as codec  # noqa: E402
from lexiloom.llm import token_counts as counts  # noqa: E402
from lexiloom.llm.piece_bpe import vocabulary  # noqa: E402

from . import brute  # noqa: E402

PATH = tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.sampled_from("abcdeinorstuéßñ .,'-\n\t▁<>0 19ATα日😀"), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_count_and_ids_are_the_librarys(text):
    assert counts.count_and_cut(text, counts.tables(PATH), 4096)[0] == len(SP.encode(text))
    assert codec.encode_slice([text], PATH)[0].tolist() == SP.encode(text)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_every_prefix(text):
    got = counts.prefix_counts(text, counts.tables(PATH))
    assert got.tolist() == [len(SP.encode(text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(0, 12))
def test_cut_is_the_longest_prefix_within_the_limit(text, limit):
    n, cut = counts.count_and_cut(text, counts.tables(PATH), limit)
    fits = [k for k in range(len(text) + 1) if len(SP.encode(text[:k])) <= limit]
    assert n == len(SP.encode(text)) and cut == (len(text) if n <= limit else cut) and cut in fits


def test_token_counts_over_awkward_rows(spark):
    rows = counts.token_counts(brute.docs(spark), PATH, limit=10).collect()
    want = sorted((repr(i), len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 10) for i, t in brute.AWKWARD)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert counts.token_counts(brute.empty(spark), PATH).count() == 0


def test_stored_prefixes_answer_budgets(spark):
    table = counts.prefix_table(brute.docs(spark, [(1, "hello there, world"), (2, None)]), PATH)
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in table.select("doc_id", counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(5)).alias("n"), counts.prefix_within(F.col("prefix_tokens"), 2).alias("c")).collect()}
    assert rows[1].n == len(SP.encode("hello")) and len(SP.encode("hello there, world"[: rows[1].c])) <= 2 and rows[2].n == 0


def test_round_trip_over_awkward_rows(spark):
    coded = codec.encode(brute.docs(spark), PATH)
    assert all(r.round_trip for r in coded.collect()) and coded.count() == len(brute.AWKWARD)
    back = sorted((repr(r.doc_id), r.text) for r in codec.decode(coded, PATH).collect())
    assert back == sorted((repr(i), (t or "").replace("▁", " ")) for i, t in brute.AWKWARD)
    assert codec.encode(brute.empty(spark), PATH).count() == 0


def test_many_segments_in_one_index():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeiourstn éß,.\n ") for _ in range(rng.randrange(400))) for _ in range(300)]
    assert [x.tolist() for x in codec.encode_slice(texts, PATH)] == [SP.encode(t) for t in texts]


def test_decode_replaces_broken_bytes():
    v = vocabulary(PATH)
    assert v.decode([v.byte_id[0xFF]]) == "�" and v.decode([]) == ""


def test_pieces_are_found_everywhere_by_few_comparisons():
    """Every occurrence of every piece against str.find, and the characters that the search for pieces reads."""

    class Read(np.ndarray):
        count = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            Read.count += np.size(out)
            return out

    matcher = codec.Matcher(vocabulary(PATH))
    text = "\0".join(["▁the▁internationalization", "▁𝔘nder", "▁über", "▁" * 9, "ation", "▁the"] + [f"▁word{k}" for k in range(300)]) + "\0" * (matcher.depth + 1)
    chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).view(Read)
    end, start, piece = matcher.edges(chars)
    want = [(k, m) for k, p in enumerate(matcher.names) for m in range(len(text)) if p[0] == text[m] and text.startswith(p, m)]
    assert sorted(zip(np.asarray(piece).tolist(), np.asarray(start).tolist())) == want and (end - start == matcher.sizes[piece]).all()
    assert Read.count < 2_000_000  # each piece in full at each step of a binary search: over ten million

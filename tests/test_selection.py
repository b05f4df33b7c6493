"""Selections: requests, choices that take each other's place, corpus tests, and ranges."""

import pytest

from lexiloom.plans.selection import Choices, Selections, boundaries, flagged, only, parsed, text_of


@pytest.mark.parametrize("request_,choice", [
    ({"author": "gr1"}, ("author", "gr1")), ({"author": "gr1", "work": "3"}, ("work", "gr1w3")), ({"author": "gr1", "work": "3", "locus": "2|4"}, ("passage", "gr1w3_AT_2|4")),
    ({"author": "gr1", "work": "3", "locus": "2", "endpoint": "9"}, ("span", "gr1w3_FROM_2_TO_9")), ({"author": "gr1", "work": "3", "locus": "2|1", "endpoint": "9"}, ("passage", "gr1w3_AT_2|1")),
    ({"genre": "epic"}, ("genre", "epic")), ({"place": "Rome;"}, ("place", "Rome")), ({}, None), ({"work": "3"}, None),
])
def test_parsed(request_, choice):
    assert parsed(request_) == choice


def test_choices_take_each_others_place():
    s = Selections().add("work", "gr1w3").add("passage", "gr1w4_AT_1").add("author", "gr2")
    assert s.chosen == Choices(("gr2",), ("gr1w3",), ("gr1w4_AT_1",))
    assert s.add("author", "gr1").chosen == Choices(("gr2", "gr1"), (), ())
    assert s.add("work", "gr1w4").chosen == Choices(("gr2",), ("gr1w3", "gr1w4"), ())
    assert s.add("passage", "gr2w1_AT_1").chosen.authors == () and s.add("passage", "gr1w3_AT_9").chosen.works == ()
    out = s.add("author", "gr1", excluded=True)
    assert out.chosen == Choices(("gr2",)) and out.excluded == Choices(("gr1",))
    assert s.add("passage", "gr1w4_AT_1", excluded=True).chosen.passages == ()
    assert s.add("work", "gr1w3").chosen.works == ("gr1w3",)


def test_only():
    assert only(("en",), ("en",)) and not only(("en", "fr"), ("en",)) and not only((), ("en",))


def test_boundaries_and_texts(spark):
    cited = spark.createDataFrame([("a", 1, k + 1, k // 3 + 1, k % 3 + 1, f"line {k}") for k in range(8)], "author string, work_id long, idx int, l1 int, l0 int, line string")
    asked = spark.createDataFrame([("aw1_AT_2",), ("aw1_AT_3|1",), ("aw1_AT_9",), ("aw1_FROM_2_TO_5",)], "selection string")
    assert sorted(tuple(r) for r in boundaries(asked, cited).collect()) == [("aw1_AT_2", 1, 4, 6), ("aw1_AT_3|1", 1, 7, 7), ("aw1_FROM_2_TO_5", 1, 2, 5)]
    lines = lambda **request: [r.idx for r in text_of(request, cited).orderBy("idx").collect()]
    assert lines(author="a") == lines(author="a", work="1") == list(range(1, 9)) and lines(author="a", work="1", locus="2") == [4, 5, 6]
    assert lines(author="a", work="1", locus="2", endpoint="3") == [2, 3] and lines() == [] and lines(author="a", work="2") == []


def test_flags(spark):
    ids = spark.createDataFrame([("aw1",), ("aw2",), ("b",)], "scope_id string")
    out = spark.createDataFrame([("aw1_AT_2",), ("aw1_FROM_1_TO_2",)], "passage string")
    assert sorted(r.scope_id for r in flagged(ids, out).collect()) == ["aw2", "ax1", "b"]

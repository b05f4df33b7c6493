import random
import re

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import walks as W


def balanced(line, tag):
    depth = 0
    for m in re.finditer(rf"<{tag}\b[^>]*>|</{tag}>", line):
        depth += -1 if m[0][1] == "/" else 1
    return depth == 0


def test_a_stray_closing_tag_hides_nothing(spark):
    rows = W.spans_over_lines(["</p>", "<p> open", "still open", "</p>"], "p")
    assert [len(r["after"]) for r in rows] == [0, 1, 1, 0]
    table = spark.createDataFrame([(1, ['<span class="a">x <span class="b">y</span>', "mid", None, "z</span> w", ""]), (2, None)], "id int, lines array<string>")
    got = {r.id: r.x for r in table.select("id", W.carried_spans(spark, F.col("lines")).alias("x")).collect()}
    assert [x.line for x in got[1]] == ['<span class="a">x <span class="b">y</span></span>', '<span class="a">mid</span>', None, '<span class="a">z</span> w', ""]
    assert [x.before for x in got[1]] == [[], ["a"], ["a"], ["a"], []] and got[2] is None


def test_random_markup_against_a_stack_over_the_whole_text():
    rng = random.Random(3)
    for _ in range(300):
        lines = ["".join(rng.choice(['<p class="a">', '<p class="b">', "<p>", "</p>", "</p>", "t", "<i>"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 7))]
        rows = W.spans_over_lines(lines, "p")
        for k in range(len(lines) + 1):
            stack = []
            for m in re.finditer(r'<p(?: class="(\w)")?>|</p>', "".join(lines[:k])):
                stack = stack[:-1] if m[0] == "</p>" else [*stack, m[1] or ""]
            assert (rows[k]["before"] if k < len(lines) else rows[-1]["after"]) == stack
        if all("</p>" not in x for x in lines):
            assert all(balanced(r["line"], "p") for r in rows)


def plain_insertions(lines):
    """Character by character, a family at a time over the whole text."""
    marks = []
    for kind, (a, b) in T.BRACKETS.items():
        inside = False
        for i, line in enumerate(lines):
            own = [c for c in line if c in a + b]
            inside = inside or bool(own and own[0] == b)
            for j, c in enumerate(line):
                if c == b and inside:
                    inside = False
                marks += [(i, j, kind)] if inside else []
                if c == a and not inside:
                    inside = True
            marks += [(i, "end", kind)] if inside else []
    return set(marks)


def test_insertions_nest_cross_and_go_on():
    rng = random.Random(5)
    for _ in range(400):
        lines = ["".join(rng.choice("[](){}⟨⟩abcd ") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
        rows, found = W.insertions_over_lines(lines), set()
        for i, r in enumerate(rows):
            assert re.sub(r"<[^>]*>", "", r["line"]) == lines[i]
            j, stack = 0, []
            for m in re.finditer(r'<span class="(\w+)">|</span>|.', r["line"]):
                if m[1]:
                    stack.append(m[1])
                elif m[0] == "</span>":
                    stack.pop()
                else:
                    found |= {(i, j, k) for k in stack}
                    j += 1
            assert not stack
            found |= {(i, "end", k) for k in r["open"]}
        assert found == plain_insertions(lines), lines


def test_insertions_by_hand(spark):
    lines = ["a [b (c", "d] e", "f) g [h] {i", '<a t="(x"> j}', None]
    want = [
        'a [<span class="square">b (<span class="round">c</span></span>', '<span class="square"><span class="round">d</span></span><span class="round">] e</span>',
        '<span class="round">f</span>) g [<span class="square">h</span>] {<span class="curly">i</span>', '<span class="curly"><a t="(x"> j</span>}', None,
    ]
    got = spark.createDataFrame([(lines,)], "lines array<string>").select(W.editorial_insertions(spark, F.col("lines")).alias("x")).first().x
    assert [r.line for r in got] == want and [r.open for r in got] == [["round", "square"], ["round"], ["curly"], [], []]


def test_marks_break_no_tag(spark):
    rows = [("<b class=\"the\">the</b> end", '<b class="the"><b>the</b></b> end'), ("t<i>h</i>e the", "<b>t</b><i><b>h</b></i><b>e</b> <b>the</b>"), ("no tag, the", "no tag, <b>the</b>"), ("<p></p>", "<p></p>"), (None, None), ("<p>the", "<p><b>the</b>"), ("the<p>", "<b>the</b><p>")]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "id int, t string").select("id", W.highlight(spark, F.col("t"), "the").alias("x")).collect()
    assert {r.id: r.x for r in got} == {k: w for k, (_, w) in enumerate(rows)}

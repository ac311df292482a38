import difflib
import random
import time

from docdelta.operators import textdiff


def made(ops):
    return tuple("".join(t for o, t in ops if o != way) for way in (1, -1))


def shortest(a, b):
    """The least number of deletions and insertions, by the table of common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return len(a) + len(b) - 2 * row[-1]


def test_scripts_are_shortest():
    draw = random.Random(5)
    for _ in range(400):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(14))) for _ in range(2))
        kept = textdiff.common(a, b)
        assert all(a[i : i + n] == b[j : j + n] and n for i, j, n in kept)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(kept, kept[1:]))
        assert len(a) + len(b) - 2 * sum(n for *_, n in kept) == shortest(a, b)
        ops = textdiff.edits(a, b)
        assert made(ops) == made(textdiff.tidy(ops)) == (a, b)


def test_limit_keeps_the_common_ends():
    a, b = "head" + "xyz" * 50 + "tail", "head" + "abc" * 50 + "tail"
    assert textdiff.common(a, b, limit=5) == [(0, 0, 4), (154, 154, 4)]
    assert made(textdiff.edits(a, b, limit=5)) == (a, b)


def test_tidy_gives_up_equalities_between_longer_changes():
    assert textdiff.tidy([(-1, "abc"), (0, "x"), (1, "def"), (0, "long enough"), (1, "q")]) == [(-1, "abcx"), (1, "xdef"), (0, "long enough"), (1, "q")]
    assert textdiff.tidy([(0, "ab"), (0, "c"), (1, "x"), (-1, "y"), (1, "z")]) == [(0, "abc"), (-1, "y"), (1, "xz")]
    assert textdiff.tidy([]) == [] and textdiff.tidy([(0, "same")]) == [(0, "same")]
    # giving one up can make the next no longer than its neighbours
    assert textdiff.tidy([(-1, "aaa"), (0, "bb"), (1, "ccc"), (0, "dddd"), (-1, "eeeee")]) == [(-1, "aaabbddddeeeee"), (1, "bbcccdddd")]


def test_long_texts(spark):
    """200,000 characters in lines and in one line; hundreds of changes; and nothing alike, where the bound holds."""
    draw = random.Random(6)
    words = [f"w{draw.randrange(10**6)}" for _ in range(28_000)]
    other = [f"n{k}" if draw.random() < 0.01 else w for k, w in enumerate(words)]
    lines = lambda ws: "\n".join(" ".join(ws[k : k + 12]) for k in range(0, len(ws), 12))
    rows = [(1, lines(words), lines(other)), (2, " ".join(words), " ".join(other)), (3, "x" * 200_000, "y" * 200_000), (4, lines(words), lines(words[:9000] + words[12000:]))]
    assert all(len(t) > 150_000 for _, *sides in rows for t in sides)
    began = time.time()
    pairs = spark.createDataFrame(rows, "pair_id bigint, word string, pdf string")
    got = {}
    for r in textdiff.sides(pairs).orderBy("pair_id", "seg", "ord").collect():
        got.setdefault(r.pair_id, []).append((r.op, r.text))
    assert {k: made(v) for k, v in got.items()} == {k: (a, b) for k, a, b in rows}
    found = {r.pair_id: r for r in textdiff.summary(textdiff.diff(pairs)).collect()}
    assert found[1].total_changes >= 250 and found[2].total_changes >= 250
    assert (found[3].deletions, found[3].insertions) == (1, 1) and found[4].total_changes < 6
    assert time.time() - began < 120


def test_segments(spark):
    """Lines that stand once on both sides part the texts unless they cross; repeated and moved lines do not."""
    a = "one\nsame\ntwo\nsame\nthree\nmoved\nfour"
    b = "zero\none\nmoved\nsame\n2\nthree\nsame\nfour"
    rows = textdiff.segments(spark.createDataFrame([(1, a, b), (2, None, "x"), (3, "", "")], "pair_id bigint, word string, pdf string")).orderBy("pair_id", "seg").collect()
    assert [(r.pair_id, r.a, r.b) for r in rows] == [(1, "", "zero\n"), (1, "one\nsame\ntwo\nsame\nthree\nmoved\n", "one\nmoved\nsame\n2\nthree\nsame\n"), (1, "four", "four"), (2, "", "x"), (3, "", "")]


def test_changes_like_another_librarys(spark):
    """What is equal after tidying covers no less than a blockwise matcher finds, on edited prose."""
    draw = random.Random(7)
    rows = []
    for k in range(40):
        words = [draw.choice(["甲方", "乙方", "合同", "付款", "2024", "责任", "金额"]) + str(draw.randrange(99)) for _ in range(60)]
        rows.append((k, "，".join(words), "，".join(w if draw.random() > 0.05 else "改" + w for w in words)))
    for _, a, b in rows:
        mine = sum(len(t) for o, t in textdiff.edits(a, b) if o == 0)
        assert mine >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())

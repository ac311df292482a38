"""Moved rows: the bound by a longest common subsequence, and blocks of rows against plain code."""

import difflib
import random

from docdelta.operators import sheets


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def test_longest_common_subsequences():
    draw = random.Random(3)
    lines = ["", "a", *("".join(draw.choices("ab你🙂1 ", k=n)) for n in (3, 20, 63, 64, 65, 127, 128, 129, 200, 300))]
    assert sheets._longest_common(lines, lines).tolist() == [[longest(a, b) for a in lines] for b in lines]
    short = [x for x in lines if len(x) <= 64]
    assert sheets._longest_common(short, lines).tolist() == [[longest(a, b) for a in short] for b in lines]
    assert sheets._longest_common([""], [""]).tolist() == [[0]]


def test_rows_of_equal_letters_in_another_order_are_not_compared(monkeypatch):
    """Sorted or not, the characters are the same; counts of characters let all these pairs through."""
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(sheets, "header_ratio", lambda a, b: asked.append((a, b)) or difflib.SequenceMatcher(None, a, b).ratio())
    a, b = ["abcdefghij"], ["jihgfedcba", "abcdefghji"]
    batch = pa.RecordBatch.from_arrays([pa.array(["s"]), pa.array([[1]]), pa.array([a]), pa.array([[5, 6]]), pa.array([b])], names=["sheet", "rows_a", "lines_a", "rows_b", "lines_b"])
    (out,) = sheets._scored(iter([batch]))
    assert out.column(2).to_pylist() == [6] and asked == [("abcdefghij", "abcdefghji")]


def test_moved_rows_against_plain_code(spark, monkeypatch):
    monkeypatch.setattr(sheets, "_BLOCK", 4)
    draw = random.Random(5)
    words = lambda n: " ".join(draw.choice("north south east west 10 20 300".split()) for _ in range(n))
    a = {r: [f"A{r}", words(draw.choice([2, 8, 30]))] for r in range(25)}
    b = {100 + r: [f"B{r}", a[r][1][: draw.randrange(9, 200)] if r % 3 else words(8)] for r in range(25)} | {300: ["A3", "x"]}
    cells = [(k, "S", r, c + 1, h, v) for k, rows in (("a", a), ("b", b)) for r, row in rows.items() for c, (h, v) in enumerate(zip(("编号", "备注"), row))]
    got = sheets.moved_rows(spark.createDataFrame(cells, "book string, sheet string, row int, col int, header string, value string")).collect()
    taken, wanted = set(), []
    for r in sorted(a):
        if r == 3:  # its key is in both books
            continue
        scored = [(-difflib.SequenceMatcher(None, " ".join(a[r]), " ".join(b[n])).ratio(), n) for n in sorted(b) if n not in taken and n != 300]
        if scored and -min(scored)[0] > 0.6:
            taken.add(min(scored)[1])
            wanted.append((r, min(scored)[1], -min(scored)[0]))
    assert len(wanted) > 5 and sorted((x.row_a, x.row_b, x.ratio) for x in got) == wanted

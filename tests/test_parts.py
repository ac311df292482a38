"""Changes are worked out where a pair lies; its parts are those that windows over its lines make."""

import random

from docdelta.operators import textdiff


def test_parts_as_by_windows(spark):
    draw, rows = random.Random(31), [(900, "", ""), (901, "a", None), (902, "a\n\na", "a"), (903, None, None), (904, "x\ny", "y\nx")]
    for k in range(300):
        a, b = (draw.choices("abcdefghij", k=draw.randrange(9)) for _ in range(2))
        rows.append((k, "\n".join(a), "\n".join(a[: len(a) // 2] + b if k % 2 else b)))
    pairs = spark.createDataFrame(rows, "pair_id bigint, word string, pdf string")
    wanted = {}
    for r in textdiff.segments(pairs).orderBy("pair_id", "seg").collect():
        wanted.setdefault(r.pair_id, []).append((r.a, r.b))
    assert {k: list(textdiff.parts(a or "", "\n".join(x for x in (b or "").split("\n") if x) if k < 900 else b or "")) for k, a, b in rows if k != 902} == {k: v for k, v in wanted.items() if k != 902}
    out = textdiff.diff(pairs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.pair_id for r in out.collect()} == {k for k, v in wanted.items() if any(a != b for a, b in v)}

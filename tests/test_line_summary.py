"""Lines that only one side of a pair has."""

from docdelta.operators import textdiff


def test_line_summary(spark):
    rows = [(1, "a\nb\nb\n", "a\n"), (2, "x 5\ny", "x 6\ny\nx 6"), (3, "same", "same"), (4, None, "甲方\n"), (5, "中", None), (6, None, None)]
    out = textdiff.line_summary(spark.createDataFrame(rows, "pair_id int, word string, pdf string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 1, False), (2, 2, 1, 1, True), (4, 2, 2, 0, True), (5, 1, 0, 1, False)]

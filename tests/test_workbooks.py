import random

from docdelta.sources import files, render


def cells(spark, hidden=True):
    rng, rows = random.Random(8), []
    for book in range(7):
        for no in rng.sample(range(50), 5):
            rows += [(f"b{book}", f"s{no}", -no, r, c, rng.choice(["", None, "x", "<&>", "12"]), no % 3 == 0) for r in range(1, 30) for c in range(1, 4)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "book string, sheet string, sheet_no bigint, row bigint, col int, value string, hidden boolean").repartition(5)


def test_workbooks_in_order(spark):
    rows, table = cells(spark)
    got = {r.book: [*files.xlsx_cells(bytes(r.content), True)] for r in render.render_workbooks(table).collect()}
    for book, found in got.items():
        mine = [r for r in rows if r[0] == book]
        assert list(dict.fromkeys(s for s, *_ in found)) == [s for _, s in sorted({(r[2], r[1]) for r in mine})]
        assert {(s, r, c): v for s, r, c, v in found if v} == {(s, r, c): v for _, s, _, r, c, v, _ in mine if v}
    shown = {r.book: {s for s, *_ in files.xlsx_cells(bytes(r.content))} for r in render.render_workbooks(table).collect()}
    assert shown == {b: {r[1] for r in rows if r[0] == b and not r[6]} for b in got}


def test_no_task_collects_sheets(spark):
    """A batch of rows that hold a sheet or a book each is as large as its rows."""
    plan = render.render_workbooks(cells(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("hashpartitioning(book") == 1

"""Pairs matched in their rows: no more is read or dealt than a result needs."""

import random

from docdelta.operators import extract, match, report
from pyspark.sql import functions as F

PIECES = ["合同总价为¥120,000.00元", "人民币 5000 元", "RMB 300.5", "违约金50000元", "费用：  8,888", "即¥270000.00元", "数量100件", "数量 100.001 件", "数量 100.005 件", "2024年1月5日", "2024年 1月 5日", "元 700", "50元", "\n", "1,234,5678", "😀 甲方", "5%"]


def pairs(spark, n=200):
    draw, rows = random.Random(23), []
    for k in range(n):
        word = draw.choices(PIECES, k=draw.randrange(9))
        pdf = word if k % 3 == 0 else [x for x in word if draw.random() < 0.8] + draw.choices(PIECES, k=k % 2)
        rows.append((k, "".join(word), "".join(pdf)))
    return spark.createDataFrame([*rows, (n, None, "费用 500元"), (n + 1, "费用 500元", None), (n + 2, None, None)], "pair_id int, word string, pdf string")


def plan(table):
    return table._jdf.queryExecution().optimizedPlan().toString()


def rows(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def test_numbers_and_amounts_of_pairs(spark):
    both = pairs(spark)
    docs = both.select("pair_id", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in ("word", "pdf"))))).where("text is not null")
    for mine, long in ((match.pair_numbers(both), match.match_numbers(extract.numbers(docs))), (match.pair_amounts(both), match.match_amounts(extract.amounts(docs)))):
        assert "Exchange" not in mine._jdf.queryExecution().executedPlan().toString()
        assert rows(mine) == rows(long) and mine.columns == long.columns


def test_contexts_are_cut_out_for_rows_that_are_read(spark):
    items = match.matched_items(pairs(spark))
    assert plan(items).count("btrim") + plan(items).count("trim(substr") > plan(match.summarise(items)).count("btrim") + plan(match.summarise(items)).count("trim(substr")
    contexts = {(r.pair_id, r.direction, r.ord): r.detail for r in items.where("family = 'numbers'").collect()}
    for r in pairs(spark).collect():
        for side, ways in (("word", ("matched", "missing_in_pdf")), ("pdf", ("extra_in_pdf",))):
            one = spark.createDataFrame([(r[side] or "",)], "text string") if r.pair_id % 40 == 1 else None
            for x in one.select(F.posexplode(extract.number_items(F.col("text")))).collect() if one else []:
                assert all(contexts.get((r.pair_id, w, x.pos), x.col.context) == x.col.context for w in ways)


def test_reports_deal_one_row_a_pair(spark):
    """The items are aggregated before they meet files or texts."""
    both = pairs(spark).select("pair_id", "word", "pdf")
    items = match.matched_items(both).withColumn("risk", F.lit("high"))
    files = both.select("pair_id", F.lit("w").alias("word_file"), F.lit("p").alias("pdf_file"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    told = report.text_report(items, files)
    text = plan(told)
    assert text.index("Join LeftOuter") < text.index("collect_list") and {r.pair_id for r in told.collect()} == {r.pair_id for r in both.collect()}
    html = plan(report.html_report(items, both))
    assert "NOT (direction" in html[html.index("collect_list") :] or "<> matched" in html

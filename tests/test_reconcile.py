"""Pairs read and matched in their rows, against plain code and against the families in long form."""

import model
import numpy as np
from pyspark.sql import functions as F

from docdelta.operators import extract, match

PIECES = [
    "合同总价为¥120,000.00元", "人民币 5000 元", "RMB 300.5", "违约金50000元", "费用：  8,888", "金额为 $ 99元", "包干费用为¥900000.00元", "第3条", "第12款", "附12", "图345", "1.0", "9.5", "99 号", "A123", "123B", "数量100件", "数量 100.001 件",
    "2024年1月5日", "2024-01-05", "2024.3.7", "5月6日 2024年", "13/1/2024", "壹拾伍万元整", "零元整", "叁佰圆", "元整", "零零零元壹", "5%", "5.05%", "0.5 %", "12.25%", "，", "。", "\n", "税率", "合计", "甲方", " ", "1234567890123", "¥0.5", "¥ 1000", "元", "元 700", "金额", "50元", "费用为", "\n", "1,234,5678", "人民币", "RMB\n",
]


def test_against_the_native_families(spark):
    rng = np.random.default_rng(17)
    rows = [(k, side, "".join(rng.choice(PIECES, int(rng.integers(0, 18))))) for k in range(250) for side in ("word", "pdf")]
    rows += [(900, "word", None), (900, "pdf", "费用 500元"), (901, "word", "违约金 700 元"), (902, "pdf", "")]
    docs = spark.createDataFrame(rows, "pair_id bigint, side string, text string")
    full = docs.where("text is not null")
    native = {
        "numbers": match.match_numbers(extract.numbers(full)), "dates": match.set_match(extract.dates(full), "norm"), "amounts_words": match.set_match(extract.amount_words(full), "raw"),
        "amounts_digits": match.match_amounts(extract.amounts(full)), "percentages": match.tolerance_match(extract.percentages(full)),
    }
    wanted = set()
    for family, table in native.items():
        for r in table.collect():
            raw = r.raw if "raw" in table.columns else r.value
            other = r.other if family in ("numbers", "amounts_digits") else None
            wanted.add((r.pair_id, family, r.direction, r.ord, raw, other))
    got = match.matched_items(match.pairs(docs)).collect()
    mine = [(r.pair_id, r.family, r.direction, r.ord, r.value if r.family == "percentages" else r.raw, r.other) for r in got]
    assert len(mine) == len(set(mine)) and set(mine) == wanted
    plain = {(k, *found[:5]) for k, word, pdf in match.pairs(docs).collect() for f in model.matched(word, pdf) for found in [(*f[:3], f[5] if f[0] == "percentages" else f[3], f[4])]}
    assert set(mine) == plain
    assert {f for _, f, *_ in mine} == set(native) and len(mine) > 1000


def test_summary(spark):
    docs = spark.createDataFrame([(1, "word", "费用 500元，2024年1月5日"), (1, "pdf", "费用 900元，2024年1月5日"), (2, "word", "x"), (2, "pdf", "x")], "pair_id bigint, side string, text string")
    rows = match.summarise(match.matched_items(match.pairs(docs))).collect()
    assert {(r.pair_id, r.family, r.missing, r.extra, r.total_diffs, r.has_critical_diff) for r in rows} == {(1, "numbers", 1, 1, 4, True), (1, "amounts_digits", 1, 1, 4, True)}
    assert match.matched_items(match.pairs(docs.limit(0))).select(F.count("*")).first()[0] == 0

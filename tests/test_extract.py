import pytest
from pyspark.sql import functions as F

from docdelta.functions import text as T
from docdelta.operators import extract

CASES = [
    ("numbers", "合同金额为150000元，期限365天", ["150000", "365"], []),
    ("numbers", "总金额为1,000,000元", ["1,000,000"], []),
    ("numbers", "地块编号05-02，金额100000元", ["100000"], ["05", "02"]),
    ("numbers", "银行账号6222021234567890123，金额100000元", ["100000"], ["6222021234567890123"]),
    ("numbers", "印章编码B621JE，金额100000元", ["100000"], ["621"]),
    ("numbers", "第123条 附456 图789 数量1.5", [], ["123", "456", "789", "1.5"]),
    ("dates", "2024年1月15日 和 2024-01-15、2024/01/15、2024.01.15", ["2024年1月15日"], ["2024-01-15"]),
    ("amounts_digits", "¥900000.00", ["900000.00"], []),
    ("amounts_digits", "违约金50000元", ["50000"], []),
    ("amounts_digits", "人民币100000元", ["100000"], []),
    ("amounts_digits", "包干费用为¥900000.00元", ["900000.00"], []),
    ("amounts_digits", "金额50元", [], ["50"]),
    ("amounts_digits", "总金额：100000元", [], ["100000"]),
    ("amounts_digits", "金额50.00元", ["50.00"], []),
    ("amounts_words", "合同总价为壹拾伍万元整", ["壹拾伍万元整"], []),
    ("amounts_words", "零零零零元整 元", [], ["零零零零元整", "元"]),
    ("percentages", "甲方占60%，乙方占40%，税率3.5％", ["60%", "40%", "3.5%"], []),
]


@pytest.mark.parametrize("family,text,has,lacks", CASES)
def test_fields(spark, family, text, has, lacks):
    docs = spark.createDataFrame([(1, "word", text)], "pair_id bigint, side string, text string").withColumn("text", T.normalise(F.col("text")))
    raw = [r.raw for r in extract.FAMILIES[family](docs).collect()]
    assert set(has) <= set(raw) and not set(lacks) & set(raw)


def test_quirks(spark):
    """Folded commas and stops join numbers; spaced dates keep their blanks; the yen sign is a keyword."""
    docs = spark.createDataFrame([(1, "数量100，200件 金额500。30天"), (2, "2024年 1月 5日"), (3, "即¥270000.00元")], "pair_id bigint, text string").withColumn("text", T.normalise(F.col("text")))
    assert [r.raw for r in extract.numbers(docs.where("pair_id = 1")).collect()] == ["100,200", "500.30"]
    assert [r.norm for r in extract.dates(docs.where("pair_id = 2")).collect()] == ["2024- 1- 5"]
    assert [r.keyword for r in extract.amounts(docs.where("pair_id = 3")).collect()] == ["¥"]


def test_normalise_in_full(spark):
    row = spark.createDataFrame([("①㎡…％￥，Ａ",), (None,), ("plain",)], "t string").select(T.normalise(F.col("t")).alias("t")).collect()
    assert [r.t for r in row] == ["1m2...%¥,A", None, "plain"]


def test_spans(spark):
    import re

    from docdelta.functions.spans import spans

    text = "第1条 甲12 𠮷34合5 6"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(spans(F.col("t"), r"\d+").alias("s")).collect()
    assert [(x.raw, x.start, x.end) for x in got[0].s] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", text)]
    assert got[1].s == [] and not got[2].s

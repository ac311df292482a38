"""Texts are searched once for what several families rest on; short cuts give what the plain rules give."""

import random
import re

from pyspark.sql import functions as F

from docdelta.functions import spans, vocab
from docdelta.operators import extract, match


def kept(text):
    """FN-10, number by number."""
    found, out = list(re.finditer(vocab.NUMBER, text, re.ASCII)), []
    for k, m in enumerate(found):
        before = text[found[k - 1].end() if k else 0 : m.start()]
        after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        raw, prev, nxt, bare = m[0], before[-1:], after[:1], m[0].replace(",", "")
        whole, _, part = bare.partition(".")
        figure = prev in [*"附图表章节号"] or (nxt in ["号", "条"] and prev in ["第", "条"])
        clause = prev == "第" and re.search("[条款项]", after[:2])
        short = len(part) == 1 and len(whole) <= 2 and float(bare) < 10
        if 3 <= len(bare.replace(".", "")) <= 12 and not re.search("[A-Za-z]", prev + nxt) and not (float(bare) == 1 and "." in raw) and not clause and not figure and not short:
            out.append(raw)
    return out


def test_which_numbers_are_fields(spark):
    rng, pieces = random.Random(3), ["123", "1,234", "1.0", "01.0", "001.00", "1.00", "09.5", "19.5", "9.50", "0,001.0", "12", "1234567890123", "第", "条", "款", "项", "号", "附", "图", "A", "z", "\0", "\n", ",", ".", " ", "中", "😀", "٣"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randrange(1, 9)))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.raws for r in docs.select("id", F.transform(extract.number_items(F.col("text")), lambda s: s["raw"]).alias("raws")).collect()}
    assert got == {k: kept(t) for k, t in rows}


def test_numbers_are_searched_once_a_side(spark):
    plan = match.matched_items(spark.createDataFrame([(1, "a", "b")], "pair_id int, word string, pdf string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {vocab.NUMBER}, 0)") == 2


def test_class_in_groups(spark):
    text = "零壹贰叁合同肆伍 陆柒捌玖拾佰仟万亿中圆元整角分abc丁"
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(spans.grouped_class(vocab.AMOUNT_WORDS[1:-2]) + "+"), F.lit(0))).first()
    assert row[0] == re.findall(vocab.AMOUNT_WORDS, text)


def test_amounts_with_other_keywords(spark):
    docs = spark.createDataFrame([(1, "工本费 300元，定金：4500")], "id int, text string")
    out = extract.amounts(docs, ["工本费", "定金："]).collect()
    assert {(r.raw, r.keyword) for r in out} == {("300", "工本费")}


def test_all_families_read_a_text_once(spark):
    docs = spark.createDataFrame([(1, "甲方：远方贸易有限公司，电话010-12345678，金额 500元，5%"), (2, None), (3, "")], "id int, text string")
    found = extract.extract_all(docs)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.family, r.ord, r.raw, r.norm, r.value) for r in found.collect()} == {
        (1, "party_names", 0, "甲方：远方贸易有限公司", "远方贸易有限公司", None), (1, "contact_info", 0, "010-12345678", "010-12345678", None),
        (1, "amounts_digits", 0, "500", "500", 500.0), (1, "numbers", 0, "010", "010", 10.0), (1, "numbers", 1, "12345678", "12345678", 12345678.0), (1, "numbers", 2, "500", "500", 500.0), (1, "percentages", 0, "5%", "5%", 0.05),
    }


def test_places_are_not_worked_out_where_none_are_told(spark):
    docs = spark.createDataFrame([(1, "第一条 项目")], "id int, text string")
    for run in (extract.parties, extract.contract_numbers, extract.clauses, extract.contacts, extract.durations):
        assert "split(" not in run(docs)._jdf.queryExecution().optimizedPlan().toString()

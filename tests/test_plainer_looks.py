"""What is looked for before a pattern leaves its finds as they are; what all families read is what each one reads."""

import random
import re

from docdelta.functions import spans, vocab
from docdelta.operators import extract
from pyspark.sql import functions as F

PIECES = ["甲方：", "乙方（", "丙方 ", "3方)\n: ", "远方贸易有限公司", "）", "第一条 项目，", "第2章", "仲裁", "仲裁条款", "保密", "保密协议", "13912345678", "010-1234567", "(021) 0212 12345678", "a@b.cn", "工期：30天。", "合同编号:HT-1.", "\n", "😀", "500元"]


def test_places_of_a_word(spark):
    texts = ["仲裁", "😀仲裁条款仲裁", "仲仲裁裁", "", "无", "aaa aa", None, "a.c abc a.c"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("仲裁", "aa", "a.c"):
        got = [r.p or [] for r in table.select(spans.places(F.col("t"), word).alias("p")).collect()]
        assert got == [[m.start() for m in re.finditer(re.escape(word), t or "")] for t in texts]


def test_all_families_as_each(spark):
    draw = random.Random(29)
    texts = ["".join(draw.choices(PIECES, k=draw.randrange(12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    every = {}
    for r in extract.extract_all(docs).collect():
        every.setdefault(r.family, []).append((r.id, r.ord, r.raw, r.norm))
    one = {"clauses": (extract.clauses, "title"), "contact_info": (extract.contacts, "norm"), "legal_terms": (extract.legal_terms, "category"), "party_names": (extract.parties, "name"), "numbers": (extract.numbers, "raw")}
    for family, (run, norm) in one.items():
        assert sorted(every[family]) == sorted((r.id, r.ord, r.raw, r[norm]) for r in run(docs).collect())
    for family, patterns in (("party_names", vocab.PARTY_SHAPES[:2]), ("contact_info", [vocab.CONTACT_MOBILE])):
        for k, t in enumerate(texts):
            raws = [m[0] for p in patterns for m in re.finditer(p, t, re.ASCII)]
            assert raws == [raw for i, _, raw, _ in sorted(every[family]) if i == k][: len(raws)]


def test_terms_that_stand_once_are_not_searched_by_pattern(spark):
    plan = extract.extract_all(spark.createDataFrame([(1, "a")], "id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "locate(仲裁" in plan and plan.count(f"{vocab.CLAUSE}, 1)") == 0

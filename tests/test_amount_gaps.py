import itertools
import random
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from docdelta.functions import text as T
from docdelta.operators import extract

sys.path.insert(0, str(Path(__file__).resolve().parent))
import model  # noqa: E402


def seconds(docs, run):
    times = []
    for _ in range(3):
        began = time.time()
        run(docs).write.format("noop").mode("overwrite").save()
        times.append(time.time() - began)
    return min(times)


def test_labels_and_signs_of_any_length(spark):
    rng = random.Random(5)
    heads = ["包干费用", "合同总价", "费用", "元", "¥", "$", "＄", "￥", "人民币", "RMB", "无", "总价 ", "税", ""]
    rests = ["", "为", " 为 ¥", "：  ", ":\n", " " * 60, "为" + "\t" * 40, "¥¥", "$为", "：：", "\v", "为 元"]
    texts = [f"前文{h}{r}5000元后{h2}  元{r}300 元" for h, r, h2 in itertools.product(heads, rests, heads[:5])]
    texts += ["".join(rng.choice([*heads, *rests, "100", "2,000.5", " 元", "12"]) for _ in range(12)) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "n bigint, text string")
    got = {}
    for r in extract.amounts(docs).orderBy("n", "ord").collect():
        got.setdefault(r.n, []).append((r.raw, model._BARE.sub("", r.keyword).lower()))
    assert [got.get(n, []) for n in range(len(texts))] == [[(raw, word) for raw, _, word, _ in model.amounts(t)] for t in texts]


def test_strip_of_all_white_space(spark):
    texts = [f"{c}a{c}b{c}{c}" for c in map(chr, [*range(0x3100), 0xFEFF]) if not 0xD800 <= ord(c) < 0xE000] + ["", " ", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("plain")).collect():
        assert r.s == r.plain


def test_what_stands_between_numbers_is_not_searched_for_labels(spark):
    gap = F.repeat(F.lit("项目概况与付款方式以及争议解决"), 25)
    docs = spark.range(0, 4_000, 1, 4).select("id", F.concat_ws("", *(x for k in range(6) for x in (gap, F.lit(f"违约金{k}000元")))).alias("text")).localCheckpoint()
    assert seconds(docs, extract.amounts) < 3 * seconds(docs, extract.numbers)

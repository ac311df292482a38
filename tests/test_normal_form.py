import random
import time
import unicodedata

from pyspark.sql import functions as F

from docdelta.functions import text as T

ODD = r"[^\x00-\x7F\x{FF01}-\x{FF5E}￥。　¥—‘-‟、〇-】一-鿿]"


def test_normal_form_of_any_characters(spark):
    rng = random.Random(3)
    common, rare = "合同金额为甲方乙方，。：（）¥￥—“”、《》abc 019\n", "㎡Ⅳ①½ﬁ…🙂é\u0000～｡"
    texts = ["", *common, *rare, *("".join(rng.choice(common + (rare if k % 2 else "")) for _ in range(rng.randrange(80))) for k in range(400)), "合同a" * 50_000 + "㎡", None]
    table = str.maketrans({**{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, "￥": "¥", "。": ".", "　": " "})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalise(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t.translate(table))) for r in got)


def test_normal_form_costs_less_than_the_class_of_all_plain_characters(spark):
    docs = spark.range(0, 24_000, 1, 4).select(F.concat(F.repeat(F.lit("第一条 项目概况，合同总价为¥100.00元，大写壹拾伍万元整。\n"), 12), "id").alias("t")).localCheckpoint()

    def seconds(x):
        times = []
        for _ in range(3):
            began = time.time()
            docs.select(x).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        return min(times)

    assert seconds(T.normalise(F.col("t"))) < seconds(F.rlike("t", F.lit(ODD)))

from pyspark.sql import functions as F

from docdelta.functions.spans import spans


def test_needs_leaves_the_matches_as_they_are(spark):
    texts = ["仲裁条款与仲裁", "无", "", None, "保密协议，保密"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("仲裁", "保密"):
        for r in docs.select(spans(F.col("t"), word, needs=word).alias("a"), spans(F.col("t"), word).alias("b")).collect():
            assert r.a == r.b

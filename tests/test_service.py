"""Keys, messages, pairs, fallbacks, bags and offered load against plain models."""

import hashlib
import hmac
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docdelta.operators import service


@pytest.mark.parametrize("secret", ["k", "s" * 64, "long " * 30])
def test_key_hash_is_hmac(spark, secret):
    keys = ["", "key-1", "钥匙", "x" * 300]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k string").select("k", service.key_hash(F.col("k"), secret).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {None: None} | {k: hmac.new(secret.encode(), k.encode(), hashlib.sha256).hexdigest() for k in keys}


def test_messages(spark):
    rows = spark.range(1).select(*(service.http_message(F.lit(c)).alias(f"c{c}") for c in (401, 404, 429, 503))).first()
    assert "API Key" in rows.c401 and "404" in rows.c404 and rows.c503 == service.SERVER_MESSAGE and rows.c429 != rows.c404
    one = spark.range(1).select(service.error_text(F.lit("E1"), F.lit("error"), F.lit("m"), F.lit(True)).alias("e"), service.log_fields(a=F.lit(1), b=F.lit(None)).alias("l")).first()
    assert one.e == "[E1][ERROR] m (可恢复)" and one.l == "a=1"


def test_prompt_is_bounded(spark):
    made = spark.range(1).select(service.prompt(F.lit("w" * 9000), F.lit("p" * 10), F.array(*(F.lit(f"d{k}") for k in range(30)))).alias("p")).first().p
    assert made.count("w") == service.PROMPT_CHARS and made.count("\n- d") + made.startswith("- d") == service.PROMPT_DIFFS
    assert "已知" not in spark.range(1).select(service.prompt(F.lit("a"), F.lit("b"), F.array().cast("array<string>")).alias("p")).first().p


def test_pairs_and_fallbacks(spark):
    lists = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], ["x"]), (3, None, ["x"]), (4, ["a"] * 11, ["x"] * 12)], "k int, w array<string>, p array<string>")
    assert [tuple(r) for r in service.zip_pairs(lists, "k", "w", "p").collect()] == [(1, 0, "a", "x")]
    got = {r.k: r.r for r in lists.select("k", service.first_result(F.col("w"), F.col("p")).alias("r")).collect()}
    assert got == {1: ["a", "b"], 2: ["x"], 3: ["x"], 4: ["a"] * 11}
    assert spark.range(1).select(service.first_result(F.lit(None).cast("array<string>"), F.array().cast("array<string>")).alias("r")).first().r == []


def test_bags(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice(["word", "pdf"]), rng.choice("abc")) for _ in range(200)]
    got = Counter((r.pair_id, r.v, r.status) for r in service.match_bags(spark.createDataFrame(rows, "pair_id int, side string, v string"), "v").collect())
    want = Counter()
    for key in {(p, v) for p, _, v in rows}:
        w, p = (sum(r == (key[0], side, key[1]) for r in rows) for side in ("word", "pdf"))
        want += Counter({(*key, "matched"): min(w, p), (*key, "missing_in_pdf"): max(w - p, 0), (*key, "extra_in_pdf"): max(p - w, 0)})
    assert got == +want


def test_offered_load(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, rng.randrange(400) * 1_000_000) for i in range(300)]
    got = {r.id: r.offered for r in service.offered_load(spark.createDataFrame(rows, "client string, id int, us bigint")).collect()}
    assert got == {i: sum(d == c and u - 60_000_000 < v <= u for d, _, v in rows) for c, i, u in rows}


def test_method_by_blocks(spark):
    rows = [(1, 900, 900, m) for m in (0.0, 100.0)] + [(2, 900, 900, m) for m in (100.0, 110.0)] + [(3, 900, 700, 100.0)]
    got = {r.image_id: r.method for r in service.binarisation(spark.createDataFrame(rows, "image_id int, width int, height int, mean double")).collect()}
    assert got == {1: "sauvola", 2: "otsu", 3: "sauvola"}

"""Recognised tokens to text and fields (WIN-01 to WIN-04, FLT-01, FN-42 to FN-49, JN-15, JN-16, AGG-07, AGG-12).

A token is (doc_id, page, ord, text, confidence, x1, y1, x2, y2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def low_confidence(tokens: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FLT-01."""
    return tokens.where(F.col("confidence") < threshold)


def line_tolerance(tokens: DataFrame) -> DataFrame:
    """AGG-07: (doc_id, tolerance) from the mean height of tokens with one."""
    mean = F.avg(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1")))
    return tokens.groupBy("doc_id").agg(F.greatest(F.coalesce(mean, F.lit(20.0)) * 0.5, F.lit(8.0)).alias("tolerance"))


def lines(tokens: DataFrame) -> DataFrame:
    """WIN-01: the tokens with ``line``: a new line starts where the next token down is further away than the tolerance."""
    down = Window.partitionBy("doc_id", "page").orderBy("y1", "ord")
    mean = F.avg(F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1"))).over(Window.partitionBy("doc_id"))
    placed = tokens.withColumn("tolerance", F.greatest(F.coalesce(mean, F.lit(20.0)) * 0.5, F.lit(8.0)))
    step = F.when(F.abs(F.col("y1") - F.lag("y1").over(down)) > F.col("tolerance"), 1).otherwise(0)
    return placed.withColumn("step", step).withColumn("line", F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("step", "tolerance")


def line_texts(tokens: DataFrame) -> DataFrame:
    """WIN-02, WIN-03: (doc_id, page, line, text): tokens by x, reversed if most overlap backwards, glued or spaced by gaps."""
    line = Window.partitionBy("doc_id", "page", "line")
    along = line.orderBy("x1", "ord")
    gaps = lines(tokens).withColumns({"gap": F.lead("x1").over(along) - F.col("x2"), "rank": F.row_number().over(along), "n": F.count("*").over(line)})
    back = gaps.withColumn("reverse", (F.col("n") >= 3) & (F.sum(F.when(F.col("gap") < -5, 1).otherwise(0)).over(line) > (F.col("n") - 1) * 0.6))
    order = F.when(F.col("reverse"), -F.col("rank")).otherwise(F.col("rank"))
    final = line.orderBy("place")
    placed = back.withColumn("place", order)
    before = lambda c: F.lag(c).over(final)
    width = F.greatest((before("x2") - before("x1")) / F.greatest(F.length(before("text")), F.lit(1)), F.lit(5.0))
    sep = F.when(before("x2").isNull() | (F.col("x1") - before("x2") < width * 1.5), "").otherwise(" ")
    return placed.withColumn("piece", F.concat(sep, F.col("text"))).groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "").alias("text"))


def full_text(tokens: DataFrame) -> DataFrame:
    """WIN-04: (doc_id, text): the pages with their markers."""
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    pages = line_texts(tokens).groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered("line", "text"), lambda x: x["text"]), "\n").alias("body"))
    marked = pages.withColumn("body", F.concat(F.lit("--- 第 "), F.col("page"), F.lit(" 页 ---\n"), F.col("body")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(ordered("page", "body"), lambda x: x["body"]), "\n\n").alias("text"))


def boost(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """FN-46: confidence below 0.8 raised by what the token and the text around its first place say (the largest reason)."""
    met = tokens.join(texts.select("doc_id", F.col("text").alias("whole")), "doc_id")
    at = F.position(F.col("text"), F.col("whole")) - 1
    here = at >= 0
    near = lambda n: F.substr(F.col("whole"), F.greatest(at - n, F.lit(0)) + 1, at + F.length("text") + n - F.greatest(at - n, F.lit(0)))
    left = F.substr(F.col("whole"), F.greatest(at - 10, F.lit(0)) + 1, at - F.greatest(at - 10, F.lit(0)))
    right = F.substr(F.col("whole"), at + F.length("text") + 1, F.lit(10))
    reason = F.greatest(
        F.when(T.any_in(F.col("text"), vocab.BOOST_AMOUNT_WORDS) | F.rlike("text", F.lit(vocab.BOOST_AMOUNT)), 0.15).otherwise(0.0),
        F.when(here & (T.any_in(left, vocab.BOOST_AMOUNT_WORDS) | T.any_in(right, vocab.BOOST_AMOUNT_WORDS)), 0.1).otherwise(0.0),
        F.when(T.any_in(F.col("text"), ["年", "月", "日"]) | F.rlike("text", F.lit(vocab.BOOST_DATE)), 0.15).otherwise(0.0),
        F.when(here & F.rlike(near(15), F.lit(vocab.BOOST_DATE)), 0.1).otherwise(0.0),
        F.when(F.rlike("text", F.lit(vocab.BOOST_NUMBER)), 0.1).otherwise(0.0),
        F.when(F.rlike("text", F.lit(vocab.BOOST_PERCENT)), 0.1).otherwise(0.0),
    )
    boosted = F.when((F.col("confidence") < 0.8) & (reason > 0), F.least(F.col("confidence") + reason, F.lit(0.95))).otherwise(F.col("confidence"))
    return met.select(*(c for c in tokens.columns if c != "confidence"), boosted.alias("confidence"))


def adjacent(tokens: DataFrame) -> DataFrame:
    """JN-16: (doc_id, page, ord, value, value_confidence): the nearest token to the right on the same line, if near.

    Tokens of a page meet those in the same and the neighbouring bands of height, so the join is on keys.
    """
    band = 64
    left = tokens.select("doc_id", "page", "ord", F.col("x2").alias("edge"), F.col("y1").alias("y"), (F.col("y2") - F.col("y1")).alias("h"))
    left = left.withColumn("band", F.explode(F.sequence(F.floor((F.col("y") - F.greatest(F.col("h") * 0.5, F.lit(10.0))) / band), F.floor((F.col("y") + F.greatest(F.col("h") * 0.5, F.lit(10.0))) / band))))
    right = tokens.select("doc_id", "page", F.col("ord").alias("o"), "x1", "y1", "text", "confidence", F.floor(F.col("y1") / band).alias("band"))
    gap = F.col("x1") - F.col("edge")
    near = left.join(right, ["doc_id", "page", "band"]).where((F.col("o") != F.col("ord")) & (F.abs(F.col("y1") - F.col("y")) <= F.greatest(F.col("h") * 0.5, F.lit(10.0))) & (gap >= 0) & (gap < F.col("h") * 3))
    best = F.min_by(F.struct("text", "confidence"), F.struct(gap, F.col("y1"), F.col("x1"), F.col("o")))
    return near.groupBy("doc_id", "page", "ord").agg(best.alias("b")).select("doc_id", "page", "ord", F.col("b")["text"].alias("value"), F.col("b")["confidence"].alias("value_confidence"))


def keyword_hits(tokens: DataFrame, industry: str = "general", least: float = vocab.SIMILAR_KEYWORD) -> DataFrame:
    """JN-15, FN-45: (doc_id, keyword, value, confidence): the token that holds a keyword of an industry, or resembles it.

    Tokens are taken in reading order; one that holds the keyword replaces the best so far if it is more certain, one that
    resembles it if it was before its certainty is lowered by the likeness. The value is what follows the keyword, or
    else the neighbour's text with the mean of both confidences. Hits are few; a document's are folded for each keyword.
    """
    words = F.explode(F.array(*map(F.lit, vocab.INDUSTRY_KEYWORDS[industry]))).alias("keyword")
    longest, short = F.greatest(F.length("text"), F.length("keyword")), F.least(F.length("text"), F.length("keyword"))
    likeness = F.when(short >= F.lit(least) * longest, T.similarity(F.col("keyword"), F.col("text"))).otherwise(0.0)
    found = tokens.select("*", words).withColumn("holds", F.contains("text", F.col("keyword"))).withColumn("like", F.when(F.col("holds"), 1.0).otherwise(likeness)).where(F.col("like") >= least)
    met = found.join(adjacent(tokens), ["doc_id", "page", "ord"], "left").withColumn("own", T.value_after(F.col("keyword"), F.col("text")))
    beside = (F.col("own") == "") & (F.col("value_confidence") > 0)
    value = F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("value", F.lit("")))
    sure = F.when(beside, (F.col("confidence") + F.col("value_confidence")) / 2).otherwise(F.col("confidence") * F.col("like"))
    hit = F.struct("page", "y1", "x1", "ord", value.alias("value"), sure.alias("sure"), F.when(F.col("holds"), sure).otherwise(F.col("confidence")).alias("claim"))
    hits = met.groupBy("doc_id", "keyword").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    start = F.struct(F.lit(0.0).alias("sure"), F.lit(None).cast("string").alias("value"))
    best = F.aggregate("hits", start, lambda a, h: F.when(h["claim"] > a["sure"], F.struct(h["sure"].alias("sure"), h["value"].alias("value"))).otherwise(a))
    return hits.withColumn("b", best).where("b.value is not null").select("doc_id", "keyword", F.col("b")["value"].alias("value"), F.bround(F.col("b")["sure"], 4).alias("confidence"))


def quality_actions(images: DataFrame) -> DataFrame:
    """FN-50: the weighted score and the treatments for given contrast, blur and noise measures."""
    score = F.col("contrast") * 0.4 + (1 - F.col("blur")) * 0.35 + (1 - F.col("noise")) * 0.25
    found = F.array_compact(F.array(F.when(F.col("contrast") < 0.3, "contrast_enhance"), F.when(F.col("blur") > 0.6, "sharpen"), F.when(F.col("noise") > 0.5, "denoise")))
    actions = F.when((F.size(found) == 0) & (score < 0.4), F.array(F.lit("full_preprocess"))).otherwise(found)
    return images.withColumns({"score": score, "actions": actions})


def correct(tokens: DataFrame) -> DataFrame:
    """FN-47, FN-48: known wrong phrases, then look-alike characters of doubtful tokens beside amounts or digits.

    Adds ``post_corrected``. Characters are taken from left to right; later ones see earlier changes.
    """
    text, sure = F.col("text"), F.col("confidence")
    plain = (sure >= 0.85) | (F.length(text) < 2)
    phrases = text
    hit = F.lit(False)
    for wrong, right in vocab.PHRASE_FIXES.items():
        hit = hit | F.contains(phrases, F.lit(wrong))
        if wrong != right:
            phrases = F.replace(phrases, F.lit(wrong), F.lit(right))
    swap = {a: b for pair in vocab.LOOK_ALIKES for a, b in (pair, pair[::-1])}
    twin = lambda c: F.translate(c, "".join(swap), "".join(swap.values()))

    def step(done: Column, c: Column) -> Column:
        at = F.length(done["out"])
        near = F.concat(F.substr(done["out"], F.greatest(at - 3, F.lit(0)) + 1, F.lit(3)), F.substr(done["all"], at + 2, F.lit(3)))
        digit = F.rlike(F.concat(F.substr(done["out"], F.greatest(at, F.lit(1)), F.lit(1)), F.lit("|"), F.substr(done["all"], at + 2, F.lit(1))), F.lit(r"\d"))
        return F.struct(F.concat(done["out"], F.when((twin(c) != c) & (T.any_in(near, vocab.CORRECTION_WORDS) | digit), twin(c)).otherwise(c)).alias("out"), done["all"].alias("all"))

    swapped = T.let(phrases, lambda p: F.aggregate(F.split(p, ""), F.struct(F.lit("").alias("out"), p.alias("all")), step, lambda d: d["out"]))
    new = F.when(plain, text).when(sure < 0.6, swapped).otherwise(phrases)
    rest = [c for c in tokens.columns if c != "text"]
    return tokens.select(*rest, new.alias("text"), F.when(plain, False).otherwise(hit | (new != phrases)).alias("post_corrected"))


def merge_reread(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """FN-49, AGG-12: tokens below 0.6 take the text of their best candidate (doc_id, page, ord, new_text, score), if any."""
    best = candidates.groupBy("doc_id", "page", "ord").agg(F.max_by("new_text", "score").alias("new_text"), F.max("score").alias("score"))
    met = tokens.join(best, ["doc_id", "page", "ord"], "left")
    use = (F.col("confidence") < 0.6) & F.col("new_text").isNotNull()
    rest = [c for c in tokens.columns if c not in ("text", "confidence")]
    return met.select(*rest, F.when(use, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(use, F.greatest("confidence", "score")).otherwise(F.col("confidence")).alias("confidence"))

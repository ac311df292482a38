"""Matching of the fields of two sides (JN-01 to JN-06) and its summary (AGG-01).

Inputs are field tables with pair_id, side ('word' or 'pdf'), ord and the family's values, or pairs of texts, which are
read and matched row by row (:func:`matched_items`). Results are rows (pair_id, direction, ...) with direction matched,
missing_in_pdf or extra_in_pdf.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.spans import context
from . import extract


def set_match(fields: DataFrame, value: str) -> DataFrame:
    """JN-01, JN-02: word items with their value on the other side match, duplicates kept; the rest by anti-joins.

    One shuffle: presence on either side is a window over (pair_id, value), not a join of the two sides.
    """
    here = Window.partitionBy("pair_id", value)
    both = fields.withColumns({"in_word": F.max(F.col("side") == "word").over(here), "in_pdf": F.max(F.col("side") == "pdf").over(here)})
    direction = F.when((F.col("side") == "word") & F.col("in_pdf"), "matched").when(F.col("side") == "word", "missing_in_pdf").when(~F.col("in_word"), "extra_in_pdf")
    return both.select("pair_id", direction.alias("direction"), "ord", F.col(value).alias("value")).where("direction is not null")


def _both(fields: DataFrame, item: Column) -> DataFrame:
    """(pair_id, w, p): the items of both sides in order."""
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, item)))
    return fields.groupBy("pair_id").agg(of("word").alias("w"), of("pdf").alias("p"))


#: What is told of an item. A number has the place of its context instead of the context, which is cut out where it is read.
_FOUND = "direction:string,ord:int,raw:string,other:string,value:double,detail:string,start:int,end:int"
_FIELDS = dict(f.split(":") for f in _FOUND.split(","))


def _found(direction, ord_: Column, raw=None, other=None, **more: Column) -> Column:
    known = {"direction": F.lit(direction) if isinstance(direction, str) else direction, "ord": ord_.cast("int"), "raw": raw, "other": other, **more}
    return F.struct(*((F.lit(None).cast(kind) if known.get(c) is None else known[c]).alias(c) for c, kind in _FIELDS.items()))


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.struct(i.alias("ord"), x.alias("x")))


def matched_sets(w: Column, p: Column) -> Column:
    """JN-01, JN-02 on the arrays of both sides' items (raw, detail): what is equal is on both sides, duplicates kept."""
    word = F.transform(w, lambda x, i: _found(F.when(F.exists(p, lambda o: o["raw"] == x["raw"]), "matched").otherwise("missing_in_pdf"), i, x["raw"], detail=x["detail"]))
    extra = F.filter(_numbered(p), lambda o: ~F.exists(w, lambda x: x["raw"] == o["x"]["raw"]))
    return F.concat(word, F.transform(extra, lambda o: _found("extra_in_pdf", o["ord"], o["x"]["raw"], detail=o["x"]["detail"])))


def matched_shares(w: Column, p: Column, tolerance: float = vocab.PERCENT_TOLERANCE) -> Column:
    """JN-03 on the arrays of both sides' items (value, detail): an item may match many times."""
    near = lambda x, others: F.exists(others, lambda o: F.abs(x["value"] - o["value"]) < tolerance)
    word = F.transform(w, lambda x, i: _found(F.when(near(x, p), "matched").otherwise("missing_in_pdf"), i, value=x["value"], detail=x["detail"]))
    extra = F.filter(_numbered(p), lambda o: ~near(o["x"], w))
    return F.concat(word, F.transform(extra, lambda o: _found("extra_in_pdf", o["ord"], value=o["x"]["value"], detail=o["x"]["detail"])))


def matched_in_turn(w: Column, p: Column, accept: Callable[[Column, Column], Column]) -> Column:
    """JN-04, JN-05 on the arrays of both sides' items (ord, raw, detail, ...): each word item in order takes the first free
    pdf item that ``accept`` allows. The order decides the result, so this is one fold. As long as each item takes its
    counterpart, that is the first free one, so the fold begins where the sides part. There the first free item is asked
    before the others."""
    told = lambda direction, x, other=None: _found(direction, x["ord"], x["raw"], other, detail=x["detail"], start=x["start"], end=x["end"])
    start = lambda free: F.struct(free.alias("free"), F.array().cast(f"array<struct<{_FOUND}>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        after = lambda found, free: F.struct(free.alias("free"), F.array_append(a["out"], found).alias("out"))
        taken = lambda o: after(told("matched", x, o["raw"]), F.filter(a["free"], lambda f: f["ord"] != o["ord"]))
        missing = after(told("missing_in_pdf", x), a["free"])
        search = lambda: T.let(F.get(F.filter(a["free"], lambda o: accept(x, o)), 0), lambda o: F.when(o.isNull(), missing).otherwise(taken(o)))
        return T.let(F.get(a["free"], 0), lambda first: F.when(first.isNull(), missing).when(accept(x, first), taken(first)).otherwise(search()))

    def from_(n: Column) -> Column:
        """The first ``n`` items of both sides in turn, the fold over the rest."""
        head = F.zip_with(F.slice(w, F.lit(1), n), F.slice(p, F.lit(1), n), lambda x, o: told("matched", x, o["raw"]))
        rest = lambda side: F.slice(side, n + 1, F.size(side))
        tail = F.aggregate(rest(w), start(rest(p)), step, lambda a: F.concat(a["out"], F.transform(a["free"], lambda f: told("extra_in_pdf", f))))
        return F.when((n == F.size(w)) & (n == F.size(p)), head).otherwise(F.concat(head, tail))

    parted = F.array_position(F.zip_with(w, p, lambda x, o: F.coalesce(accept(x, o), F.lit(False))), F.lit(False))
    return T.let(F.when(parted == 0, F.size(w)).otherwise(parted.cast("int") - 1), from_)


def tolerance_match(fields: DataFrame, tolerance: float = vocab.PERCENT_TOLERANCE) -> DataFrame:
    """JN-03: an item matches if the other side has one strictly within the tolerance; items may match many times.

    The arrays of a pair are met in one aggregation on pair_id; ``other`` is the first matching pdf value.
    """
    pairs = _both(fields, F.struct("ord", "value"))
    near = lambda x, others: F.filter(others, lambda o: F.abs(x["value"] - o["value"]) < tolerance)
    row = lambda d, x, other: F.struct(d.alias("direction"), x["ord"].alias("ord"), x["value"].alias("value"), other.alias("other"))
    word = F.transform("w", lambda x: T.let(near(x, F.col("p")), lambda n: row(F.when(F.size(n) > 0, "matched").otherwise("missing_in_pdf"), x, F.get(n, 0)["value"])))
    pdf = F.transform(F.filter("p", lambda x: F.size(near(x, F.col("w"))) == 0), lambda x: row(F.lit("extra_in_pdf"), x, F.lit(None).cast("double")))
    return pairs.select("pair_id", F.inline(F.concat(word, pdf)))


def greedy_match(fields: DataFrame, columns: list[str], accept: Callable[[Column, Column], Column]) -> DataFrame:
    """:func:`matched_in_turn` on fields in long form."""
    place = (F.lit(None).cast("int").alias(c) for c in ("start", "end"))
    found = _both(fields, F.struct("ord", "raw", "value", *columns, *place)).select("pair_id", F.inline(matched_in_turn(F.col("w"), F.col("p"), accept)))
    return found.drop("value", "detail", "start", "end")


def _same_number(w: Column, p: Column, of: Callable[[Column, str], Column] = lambda x, side: x["detail"]) -> Column:
    """The runs of the contexts, which ``of`` gives, are looked for only where values differ and are close."""
    return (w["value"] == p["value"]) | (T.is_close(w["value"], p["value"]) & F.arrays_overlap(T.han_runs(of(w, "word")), T.han_runs(of(p, "pdf"))))


def _same_amount(w: Column, p: Column, of: Callable[[Column, str], Column] = lambda x, side: x["context"]) -> Column:
    return ((w["kw"] != "") & (w["kw"] == p["kw"]) & T.is_close(w["value"], p["value"])) | ((w["value"] == p["value"]) & F.arrays_overlap(_amount_words(of(w, "word")), _amount_words(of(p, "pdf"))))


def _amount_words(context: Column) -> Column:
    return T.let(T.keyword(context), lambda c: F.filter(F.array(*map(F.lit, vocab.AMOUNT_CONTEXT)), lambda k: F.contains(c, k)))


def match_numbers(fields: DataFrame) -> DataFrame:
    """JN-04: equal, or close with a Han run of two or more in both contexts."""
    return greedy_match(fields.withColumn("detail", F.col("context")), ["detail"], _same_number)


def match_amounts(fields: DataFrame) -> DataFrame:
    """JN-05: same keyword and close, or equal with one amount word in both contexts."""
    return greedy_match(fields.withColumns({"detail": F.col("keyword"), "kw": T.keyword(F.col("keyword"))}), ["detail", "kw", "context"], _same_amount)


def _number_context(text: Column, x: Column) -> Column:
    return context(text, x["start"], x["end"], 30, 30)


def _numbers(text: Column, found: Column) -> Column:
    """FN-10 as it takes part in matching, with places instead of contexts."""
    kept = extract.number_places(found)
    return F.transform(kept, lambda s, i: F.struct(i.alias("ord"), s["raw"].alias("raw"), T.number(s["raw"]).alias("value"), F.lit(None).cast("string").alias("detail"), s["start"].alias("start"), s["end"].alias("end")))


def _amounts(text: Column, found: Column, keywords: list[str] | None) -> Column:
    """FN-13 as it takes part in matching, with places instead of contexts."""
    item = lambda x, i: F.struct(i.alias("ord"), x["raw"].alias("raw"), T.number(x["raw"]).alias("value"), x["keyword"].alias("detail"), T.keyword(x["keyword"]).alias("kw"), *(x[c].alias(c) for c in ("start", "end", "left")))
    return F.transform(extract.amount_items(text, keywords, found), item)


def _items(text: Column, numbers: Column, keywords: list[str] | None) -> dict[str, Column]:
    """What of a text takes part in matching, by family; ``numbers`` are its tokens."""
    return {
        "numbers": _numbers(text, numbers),
        "dates": F.transform(extract.date_norms(text), lambda x: F.struct(x["norm"].alias("raw"), x["raw"].alias("detail"))),
        "amounts_words": F.transform(extract.word_texts(text), lambda x: F.struct(x.alias("raw"), F.lit(None).cast("string").alias("detail"))), "amounts_digits": _amounts(text, numbers, keywords),
        "percentages": F.transform(extract.percentage_texts(text), lambda x: F.struct((x.cast("double") / 100).alias("value"), F.concat(x, F.lit("%")).alias("detail"))),
    }


def _texts(both: DataFrame) -> DataFrame:
    return both.select("pair_id", *(F.coalesce(s, F.lit("")).alias(s) for s in ("word", "pdf")))


def _match_numbers(w: Column, p: Column) -> Column:
    return matched_in_turn(w, p, lambda x, o: _same_number(x, o, lambda i, side: _number_context(F.col(side), i)))


def _match_amounts(w: Column, p: Column) -> Column:
    return matched_in_turn(w, p, lambda x, o: _same_amount(x, o, lambda i, side: extract.amount_context(F.col(side), i)))


def pair_numbers(both: DataFrame) -> DataFrame:
    """:func:`match_numbers` of pairs (pair_id, word, pdf), read and matched in their rows: contexts are neither shuffled nor
    cut out but where values are close."""
    return _in_pairs(both, _numbers, _match_numbers)


def pair_amounts(both: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """:func:`match_amounts` of pairs (pair_id, word, pdf), read and matched in their rows."""
    return _in_pairs(both, lambda text, found: _amounts(text, found, keywords), _match_amounts)


def _in_pairs(both: DataFrame, read: Callable[[Column, Column], Column], run: Callable[[Column, Column], Column]) -> DataFrame:
    items = lambda side: read(F.col(side), extract.number_tokens(F.col(side)))
    word = _texts(both).select("*", items("word").alias("w"))
    sides = word.select("*", F.when(F.col("word") != F.col("pdf"), items("pdf")).otherwise(F.col("w")).alias("p"))
    return sides.select("pair_id", F.inline(run(F.col("w"), F.col("p")))).select("pair_id", "direction", "ord", "raw", "other")


def matched_items(both: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """(pair_id, family, direction, ord, raw, other, value, detail) of all families of each pair (pair_id, word, pdf).

    A pair's texts lie in one row, where they are read and matched: no shuffle, and no task holds more than a pair. Two
    texts that are the same are read once. Texts are to be normalised before. A null text has no items. ``raw`` is the
    norm of a date; percentages have a value and no raw. ``detail`` is a number's context, an amount's keyword, or a date
    or percentage as it stands in the text; contexts are cut out last, for the rows and queries that still need them.
    """
    how = {"numbers": _match_numbers, "dates": matched_sets, "amounts_words": matched_sets, "amounts_digits": _match_amounts, "percentages": matched_shares}
    counted = _texts(both).select("*", extract.number_tokens(F.col("word")).alias("found"))
    word = counted.select("pair_id", "word", "pdf", *(c.alias(f"{f}_word") for f, c in _items(F.col("word"), F.col("found"), keywords).items()))
    other = F.col("word") != F.col("pdf")
    found = word.select("*", F.when(other, extract.number_tokens(F.col("pdf"))).alias("found"))
    read = found.select("pair_id", "word", "pdf", *(f"{f}_word" for f in how), *(F.when(other, c).otherwise(F.col(f"{f}_word")).alias(f"{f}_pdf") for f, c in _items(F.col("pdf"), F.col("found"), keywords).items()))
    named = lambda f, items: F.transform(items, lambda x: F.struct(F.lit(f).alias("family"), *(x[c].alias(c) for c in _FIELDS)))
    rows = read.select("pair_id", "word", "pdf", F.inline(F.concat(*(named(f, run(F.col(f"{f}_word"), F.col(f"{f}_pdf"))) for f, run in how.items()))))
    text = F.when(F.col("direction") == "extra_in_pdf", F.col("pdf")).otherwise(F.col("word"))
    detail = F.when(F.col("family") == "numbers", context(text, F.col("start"), F.col("end"), 30, 30)).otherwise(F.col("detail"))
    return rows.select("pair_id", "family", "direction", "ord", "raw", "other", "value", detail.alias("detail"))


def pairs(docs: DataFrame) -> DataFrame:
    """(pair_id, word, pdf) of texts in long form (pair_id, side, text); a missing side is null."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("text"))).alias(s)
    return docs.groupBy("pair_id").agg(side("word"), side("pdf"))


def summarise(items: DataFrame) -> DataFrame:
    """AGG-01: pair_id, family, missing, extra, total_diffs, has_critical_diff of the families with differences, from
    matched items (pair_id, family, direction)."""
    count = lambda d: F.count_if(F.col("direction") == d).alias(d.split("_")[0])
    each = items.where("direction <> 'matched'").groupBy("pair_id", "family").agg(count("missing_in_pdf"), count("extra_in_pdf"))
    pair = Window.partitionBy("pair_id")
    return each.withColumns({"total_diffs": F.sum(F.col("missing") + F.col("extra")).over(pair), "has_critical_diff": F.max(F.col("family").isin("amounts_words", "amounts_digits")).over(pair)})

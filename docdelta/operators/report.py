"""Reports as tables, JSON and HTML (SNK-01 to SNK-03, SNK-05, SNK-08, SNK-09, SNK-11, WIN-05, FN-40, FN-55 to FN-57).

Input: difference items (pair_id, family, direction, raw, risk and, if there, keyword, context, norm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def label(x: Column, labels: dict[str, str]) -> Column:
    """FN-40: the display text of a code, or the code."""
    out = x
    for k, v in labels.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def numbered(items: DataFrame) -> DataFrame:
    """WIN-05: the items of each pair with ``id`` from 1, by family, direction and order of extraction."""
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    order = [place("family", ["amounts_words", "amounts_digits", "dates", "numbers", "percentages"]), place("direction", ["missing_in_pdf", "extra_in_pdf"]), *(F.col(c) for c in ("ord", "raw") if c in items.columns)]
    return items.where("direction <> 'matched'").withColumn("id", F.row_number().over(Window.partitionBy("pair_id").orderBy(*order)))


def export_json(items: DataFrame) -> DataFrame:
    """SNK-03: (pair_id, payload): the differences and their statistics as one JSON text a pair. An item's ``detail`` is a
    number's context, an amount's keyword, or a date or percentage as it stands in the text."""
    detail = lambda *families: F.when(F.col("family").isin(*families), F.col("detail")) if "detail" in items.columns else F.lit(None).cast("string")
    blank = lambda c, *families: F.coalesce(F.col(c) if c in items.columns else detail(*families), F.lit("")).alias(c)
    norm = F.col("norm") if "norm" in items.columns else F.when(F.col("family") == "dates", F.col("raw"))
    one = F.struct(
        "id", F.col("family").alias("category"), label(F.col("family"), vocab.FAMILY_LABELS).alias("category_label"), F.col("risk").alias("risk_level"), "direction",
        label(F.col("direction"), vocab.DIRECTION_LABELS).alias("direction_label"), F.coalesce(detail("dates", "percentages"), F.col("raw")).alias("value"), blank("keyword", "amounts_digits"), blank("context", "numbers"), F.coalesce(norm, F.lit("")).alias("normalized_value"),
    )
    n = lambda c, values: F.struct(*(F.count_if(F.col(c) == v).alias(v) for v in values))
    counts = lambda c, values: [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for v in values]
    risks, ways, families = ["high", "medium", "low"], ["missing_in_pdf", "extra_in_pdf"], list(vocab.FAMILY_LABELS)
    sums = numbered(items).groupBy("pair_id").agg(F.array_sort(F.collect_list(one)).alias("differences"), F.count("*").alias("n"), *counts("risk", risks), *counts("direction", ways), *counts("family", families))
    pick = lambda c, values: F.struct(*(F.col(f"{c}_{v}").alias(v) for v in values))
    present = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, families)), F.array(*(F.col(f"family_{v}") for v in families))), lambda _, v: v > 0)
    statistics = F.struct(F.col("n").alias("total_differences"), pick("risk", risks).alias("by_risk_level"), present.alias("by_category"), pick("direction", ways).alias("by_direction"))
    return sums.select("pair_id", F.to_json(F.struct(F.lit("2.0").alias("schema_version"), "differences", statistics.alias("statistics"))).alias("payload"))


#: The families of a text report in order, with how they are counted and what they are called.
SECTIONS = [("numbers", "数字", "个"), ("dates", "日期", "个"), ("amounts_words", "大写金额", "个"), ("amounts_digits", "金额数字", "对"), ("percentages", "百分比", "个")]
_WAYS = {"missing_in_pdf": ("缺失", "Word"), "extra_in_pdf": ("多出", "PDF")}


def _lines(*parts: Column) -> Column:
    """Lines one after the other; a null part is no line."""
    return F.concat_ws("\n", *parts)


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def text_report(items: DataFrame, files: DataFrame, doubtful: DataFrame | None = None) -> DataFrame:
    """SNK-01: (pair_id, report) for each of the files (pair_id, word_file, pdf_file, at): head, summary, a section for each
    family with its differences in order, doubtful items (pair_id, text, confidence, page), conclusion.

    One aggregation of the items, which is bounded by a pair's own; items of no file are left out.
    """
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    detail = F.coalesce(has("detail"), F.lit(""))
    counts, bodies = [], []
    for family, name, unit in SECTIONS:
        mine = F.col("family") == family
        counts.append(F.count_if(mine & (F.col("direction") == "matched")).alias(f"{family}_matched"))
        parts = []
        for way, (verb, side) in _WAYS.items():
            text = {
                "numbers": F.concat(F.col("raw"), F.lit(" (上下文: ..."), detail, F.lit("...)")), "dates": F.concat(F.lit(f"{side}: "), detail, F.lit(" -> 标准化: "), F.col("raw")),
                "amounts_digits": F.concat(F.lit(f"{side}: "), detail, F.lit(" = "), F.col("raw")), "percentages": F.concat(F.lit(f"{side}: "), F.coalesce(has("detail"), F.col("raw"))),
            }.get(family, F.concat(F.lit(f"{side}: "), F.col("raw")))
            order = F.col("ord") if "ord" in items.columns else F.lit(0)
            counts.append(F.array_sort(F.collect_list(F.when(mine & (F.col("direction") == way), F.struct(order.alias("ord"), text.alias("line"))))).alias(f"{family}_{way}"))
            called = "金额" if family == "amounts_digits" else name
            found = F.col(f"{family}_{way}")
            parts.append(F.when(F.size(found) > 0, _lines(F.lit(f"[DIFF] 扫描件{verb}{called}:"), F.array_join(F.transform(found, lambda x: F.concat(F.lit("   * "), x["line"])), "\n"))))
        same = F.concat(F.lit(f"[OK] 所有{name}一致（共 "), F.col(f"{family}_matched"), F.lit(f" {unit}）"))
        bodies.append(_lines(F.lit(f"--- {name}比对 ---"), F.when(F.coalesce(*parts).isNull(), same).otherwise(_lines(*parts)), F.lit("")))
    different = F.col("direction") != "matched"
    critical = F.coalesce(F.bool_or(different & F.col("family").isin("amounts_words", "amounts_digits")), F.lit(False))
    # Items are counted where they lie, before anything is dealt: a pair goes to its files as one row.
    told = items.groupBy("pair_id").agg(F.count_if(different).alias("n"), critical.alias("critical"), *counts)
    none = {c: F.lit(0) if c == "n" or c.endswith("_matched") else F.lit(False) if c == "critical" else F.array() for c in told.columns[1:]}
    names = files.groupBy("pair_id").agg(*(F.first(c).alias(c) for c in ("word_file", "pdf_file", "at")))
    sums = names.join(told, "pair_id", "left").withColumns({c: F.coalesce(c, v.cast(told.schema[c].dataType)) for c, v in none.items()})
    if doubtful is None:
        sums = sums.withColumn("low", F.array().cast("array<string>"))
    else:
        line = F.concat(F.lit('   • "'), F.col("text"), F.lit('" (置信度: '), F.format_string("%.2f", "confidence"), F.lit(", 页码: "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")"))
        low = doubtful.groupBy("pair_id").agg(F.array_sort(F.collect_list(line)).alias("low"))
        sums = sums.join(low, "pair_id", "left").withColumn("low", F.coalesce("low", F.array().cast("array<string>")))
    bar, n = F.lit("=" * 60), F.col("n").cast("string")
    verdict = F.when(F.col("n") == 0, "[OK] 所有关键字段一致，未发现差异").otherwise(F.concat(F.lit("[WARN] 发现 "), n, F.lit(" 处差异")))
    some = F.size("low") > 0
    report = _lines(
        bar, F.lit("合同扫描件比对报告"), bar, F.concat(F.lit("比对时间: "), F.date_format("at", "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("Word 文档: "), _file_name(F.col("word_file"))), F.concat(F.lit("扫描 PDF: "), _file_name(F.col("pdf_file"))), F.lit(""),
        F.lit("--- 比对摘要 ---"), verdict, F.when(F.col("critical"), "[!!] 存在金额相关差异，请重点核查！"), F.lit(""), *bodies,
        F.when(some, _lines(F.lit("--- 低置信度字段（需人工复核）---"), F.array_join("low", "\n"), F.lit(""))),
        bar, F.concat(F.lit("总结: 发现 "), n, F.lit(" 处差异")), F.when(F.col("critical"), "建议: 金额相关差异需重点人工核查"), F.when(some, F.concat(F.lit("另有 "), F.size("low").cast("string"), F.lit(" 处低置信度字段需复核"))), bar,
    )
    return sums.select("pair_id", report.alias("report"))


def full_json(items: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-02: (pair_id, payload): metadata of the files (pair_id, word_file, pdf_file, at), the summary, the details by
    family and direction, and the doubtful items (those with a ``confidence`` below 0.6)."""
    doubtful = F.filter(F.collect_list(F.when(F.col("confidence") < 0.6, F.col("raw"))), lambda x: x.isNotNull()) if "confidence" in items.columns else F.array().cast("array<string>")
    different = F.col("direction") != "matched"
    critical = F.coalesce(F.bool_or(F.col("family").isin("amounts_words", "amounts_digits") & different), F.lit(False))
    listed = lambda f, d: F.array_sort(F.filter(F.collect_list(F.when((F.col("family") == f) & (F.col("direction") == d), F.col("raw"))), lambda x: x.isNotNull()))
    details = lambda f: F.struct(*(listed(f, d).alias(d) for d in ("matched", "missing_in_pdf", "extra_in_pdf")), F.coalesce(F.bool_or((F.col("family") == f) & different), F.lit(False)).alias("has_diff"))
    sums = files.join(items, "pair_id", "left").groupBy("pair_id").agg(
        *(F.first(c).alias(c) for c in ("word_file", "pdf_file", "at")), F.struct(F.count_if(different).alias("total_diffs"), critical.alias("has_critical_diff")).alias("summary"),
        F.struct(*(details(f).alias(f) for f, *_ in SECTIONS)).alias("details"), F.array_sort(doubtful).alias("low_confidence_items"),
    )
    meta = F.struct(F.col("at").cast("string").alias("timestamp"), "word_file", "pdf_file").alias("metadata")
    return sums.select("pair_id", F.to_json(F.struct(meta, "summary", "details", "low_confidence_items")).alias("payload"))


def html_report(items: DataFrame, texts: DataFrame) -> DataFrame:
    """SNK-11: (pair_id, html): a page with the sums and kinds of differences, a table of what the scan lacks, and both texts
    (pair_id, word, pdf), what is lacking marked in the first."""
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    families = ["amounts_digits", "dates", "numbers"]
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("family"))
    shown = F.coalesce(*(F.when(F.col("family") == "dates", F.col("detail")) if "detail" in items.columns else F.lit(None).cast("string"),), F.col("raw"))
    row = F.concat(F.lit("<tr>"), cell(label(F.col("family"), vocab.FAMILY_LABELS)), cell(T.escape_html(shown)), cell(F.lit("缺失")), cell(F.lit("差异")), F.lit("</tr>"))
    lost = (F.col("direction") == "missing_in_pdf") & F.col("family").isin(families)
    some = lambda x: F.array_sort(F.filter(F.collect_list(x), lambda v: v.isNotNull()))
    different = F.col("direction") != "matched"
    kinds = F.array_distinct(some(F.when(different, F.struct(place([f for f, *_ in SECTIONS]).alias("p"), label(F.col("family"), vocab.FAMILY_LABELS).alias("k")))))
    critical = F.bool_or(F.col("family").isin("amounts_words", "amounts_digits") & different)
    sums = items.where(different).groupBy("pair_id").agg(  # a pair without differences has no sums
        F.count("*").alias("n"), critical.alias("critical"), kinds.alias("kinds"), some(F.when(lost, F.struct(place(families).alias("p"), F.col("raw"), row.alias("row")))).alias("rows"),
        F.array_distinct(some(F.when(lost, shown))).alias("terms"),
    )
    both = texts.join(sums, "pair_id", "left")
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="zh-CN"><head><meta charset="UTF-8"><title>合同比对报告</title></head><body>\n<h1>合同比对报告</h1>\n<p>差异总数: '), F.coalesce("n", F.lit(0)).cast("string"),
        F.lit("</p>\n<p>存在金额差异: "), F.when(F.coalesce("critical", F.lit(False)), "是").otherwise("否"),
        F.lit("</p>\n<p>差异类型: "), F.coalesce(F.array_join(F.transform("kinds", lambda x: x["k"]), "、"), F.lit("")),
        F.lit("</p>\n<h2>差异明细</h2>\n<table>\n<tr><th>类型</th><th>Word 原文</th><th>PDF 扫描件</th><th>状态</th></tr>\n"),
        F.coalesce(F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("")),
        F.lit("\n</table>\n<div>"), highlight(F.coalesce("word", F.lit("")), F.coalesce("terms", F.array().cast("array<string>"))), F.lit("</div>\n<div>"), T.escape_html(F.coalesce("pdf", F.lit(""))), F.lit("</div>\n</body></html>"),
    )
    return both.select("pair_id", page.alias("html"))


def difference_tables(items: DataFrame) -> dict[str, DataFrame]:
    """SNK-05: the summary, a table for each family and the full list; long phrases are cut."""
    rows = numbered(items).withColumns({"risk_label": label(F.col("risk"), vocab.RISK_LABELS), "direction_label": label(F.col("direction"), vocab.DIRECTION_LABELS)})
    if "phrase" in rows.columns:
        rows = rows.withColumn("phrase", F.when(F.length("phrase") > 60, F.concat(F.left("phrase", F.lit(57)), F.lit("..."))).otherwise(F.col("phrase")))
    out = {"summary": rows.groupBy("pair_id", "family").agg(F.count("*").alias("n"))}
    return out | {f: rows.where(F.col("family") == f) for f in vocab.FAMILY_LABELS} | {"all": rows}


def sheet_report(diffs: DataFrame) -> DataFrame:
    """SNK-08: cell differences with their labels and tab names of at most 31 characters."""
    return diffs.select(F.left("sheet", F.lit(31)).alias("tab"), "row", "col", "col_name", "value_a", "value_b", label(F.col("risk"), vocab.RISK_LABELS).alias("risk"), "category", label(F.col("risk"), vocab.RISK_COLOURS).alias("colour"))


def html_cards(ops: DataFrame, most: int = 100) -> DataFrame:
    """SNK-09: (pair_id, html): cards of a pair's first differences, 30 characters of context on both sides."""
    esc = lambda c: T.escape_html(F.col(c))
    card = F.concat(F.lit('<div class="diff '), F.col("risk"), F.lit(' '), F.col("type"), F.lit('">'), T.escape_html(F.right("context_before", F.lit(30))), F.lit("<b>"), esc("text"), F.lit("</b>"), T.escape_html(F.left("context_after", F.lit(30))), F.lit("</div>"))
    first = ops.withColumn("n", F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))).where(F.col("n") <= most)
    return first.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", card.alias("c")))), lambda s: s["c"]), "\n").alias("html"))


def segments(text: Column, terms: Column, mode: str) -> Column:
    """FN-55: array<struct<mode, text>>: the first place of each term marked, the rest normal."""
    mark, normal = "\ue000", "normal"  # a private character, in no text
    marked = F.aggregate(terms, text, lambda a, t: T.let(F.position(t, a), lambda at: F.when((at > 0) & (t != ""), F.concat(F.substr(a, F.lit(1), at - 1), F.lit(mark + "1"), t, F.lit(mark + "0"), F.substr(a, at + F.length(t)))).otherwise(a)))
    parts = F.split(F.concat(F.lit("0"), marked), mark, -1)
    return F.filter(F.transform(parts, lambda p: F.struct(F.when(F.startswith(p, F.lit("1")), mode).otherwise(normal).alias("mode"), F.substr(p, F.lit(2)).alias("text"))), lambda s: s["text"] != "")


def highlight(text: Column, terms: Column, css: str = "diff") -> Column:
    """FN-56, SRT-07: the first place of each term, longest first, in a span; the rest escaped."""
    longest = F.transform(F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), lambda s: s["t"])
    return F.array_join(F.transform(segments(text, longest, "hit"), lambda s: F.when(s["mode"] == "hit", F.concat(F.lit(f'<span class="{css}">'), T.escape_html(s["text"]), F.lit("</span>"))).otherwise(T.escape_html(s["text"]))), "")


def snippet(text: Column, term: Column, width: int = 30) -> Column:
    """FN-57: the first place of a term with what stands around it; empty if it does not occur."""
    return T.let(F.position(term, text), lambda at: F.when(at == 0, "").otherwise(F.substr(text, F.greatest(at - width, F.lit(1)), F.length(term) + width + at - F.greatest(at - width, F.lit(1)))))

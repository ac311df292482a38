"""Text functions on columns: native expressions, but for full compatibility folding of unusual characters."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_FOLDED = ("￥。　", "¥. ")
_BLANK = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.btrim(x, F.lit(_BLANK))


def fold_width(x: Column) -> Column:
    """FN-01 for the characters that contracts have: full-width forms, the ideographic stop and space, the yen sign."""
    return F.translate(x, _WIDE + _FOLDED[0], _NARROW + _FOLDED[1])


def _nfkc(x: Column) -> Column:
    table = str.maketrans(_WIDE + _FOLDED[0], _NARROW + _FOLDED[1])

    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: unicodedata.normalize("NFKC", t.translate(table)), na_action="ignore")

    return nfkc(x)


def normalise(x: Column) -> Column:
    """FN-01 in full: :func:`fold_width`, then NFKC. Only texts with characters that need more than folding go to Python.

    The test takes runs of each class, which costs a tenth of asking of each character whether it is in none of them.
    """
    odd = ~F.rlike(x, F.lit(r"\A(?:[\x00-\x7F]++|[一-鿿]++|[\x{FF01}-\x{FF5E}￥。　¥—‘-‟、〇-】]++)*+\z"))
    return F.coalesce(_nfkc(F.when(odd, x)), fold_width(x))


def diff_normalise(x: Column) -> Column:
    """FN-02: line ends, runs of blanks, blank lines."""
    lines = F.split(F.regexp_replace(F.regexp_replace(x, "\r\n|\r", "\n"), "[ \t]+", " "), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, strip), lambda t: t != ""), "\n")


def squeeze(x: Column) -> Column:
    """FN-03: runs of white space become one blank."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def keyword(x: Column) -> Column:
    """FN-04."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[^\w一-鿿]", ""))


def header(x: Column) -> Column:
    """FN-05."""
    return F.lower(F.regexp_replace(x, r"(?U)[\s\-_·•:：()（）\[\]【】]", ""))


def cell(x: Column) -> Column:
    """FN-06 on a cell's text."""
    return squeeze(F.coalesce(x, F.lit("")))


def han_runs(x: Column) -> Column:
    """FN-07."""
    return F.regexp_extract_all(x, F.lit("[一-鿿]{2,}"), F.lit(0))


def escape_html(x: Column) -> Column:
    """FN-08, with quotes."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], x)


def zfill2(x: Column) -> Column:
    return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)


def normalise_date(x: Column) -> Column:
    """FN-30: YYYY-MM-DD by text alone; null unless there are three parts."""
    flat = F.regexp_replace(F.translate(F.regexp_replace(x, "[年/.月]", "-"), "日号", ""), "^-+|-+$", "")
    return let(F.split(flat, "-", -1), lambda p: F.when(F.size(p) == 3, F.concat_ws("-", F.get(p, 0), zfill2(F.get(p, 1)), zfill2(F.get(p, 2)))))


def number(x: Column) -> Column:
    """FN-31."""
    return F.replace(x, F.lit(","), F.lit("")).cast("double")


def cell_number(x: Column) -> Column:
    """FN-32 on a cell's text: separators and currency signs dropped, per cent divided; null if it is no number."""
    bare = F.regexp_replace(F.replace(strip(x), F.lit(","), F.lit("")), "[¥￥$€]", "")
    return F.when(F.endswith(bare, F.lit("%")), F.regexp_replace(bare, "%$", "").try_cast("double") / 100).otherwise(bare.try_cast("double"))


def looks_like_date(x: Column) -> Column:
    """FN-34."""
    return F.rlike(strip(x), F.lit(r"^(?:\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}[日号]?|\d{4}年\s*\d{1,2}月\s*\d{1,2}日|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})$"))


def any_in(x: Column, words: list[str]) -> Column:
    """Whether one of the words occurs."""
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def cell_category(a: Column, b: Column, name: Column) -> Column:
    """FN-33 on texts of cells."""
    low, na, nb = F.lower(name), cell_number(a), cell_number(b)
    return (
        F.when(any_in(low, vocab.DATE_HEADERS) & (looks_like_date(a) | looks_like_date(b)), "date")
        .when(na.isNotNull() & nb.isNotNull(), "number")
        .when((na.isNotNull() | nb.isNotNull()) & any_in(low, vocab.FINANCIAL_HEADERS), "number")
        .when(F.startswith(a, F.lit("=")) | F.startswith(b, F.lit("=")), "formula").otherwise("text")
    )


def cell_risk(category: Column, name: Column) -> Column:
    """FN-35."""
    return F.when((category == "date") | ((category == "number") & any_in(F.lower(name), vocab.FINANCIAL_HEADERS)), "high").otherwise("medium")


def classify_diff(x: Column) -> Column:
    """FN-38: struct(risk, category)."""
    kind = lambda r, c: F.struct(F.lit(r).alias("risk"), F.lit(c).alias("category"))
    return F.when(F.rlike(x, F.lit(r"(?U)\d")), kind("high", "number")).when(any_in(x, vocab.DIFF_LEGAL_WORDS), kind("high", "keyword")).when(F.rlike(x, F.lit(r"(?U)^[\s\W_]+$")), kind("low", "text")).otherwise(kind("medium", "text"))


def is_close(a: Column, b: Column) -> Column:
    """JN-06."""
    return F.abs(a - b) <= F.greatest(F.lit(vocab.RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(vocab.ABSOLUTE_TOLERANCE))


def similarity(a: Column, b: Column) -> Column:
    """FN-42: edit distance over the longer length, as likeness; 0 if one is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def value_after(word: Column, x: Column) -> Column:
    """FN-43: what follows a keyword and a sign, or else the next word."""
    quoted = F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))
    find = lambda tail: F.call_function("regexp_extract", x, F.concat(quoted, F.lit(tail)), F.lit(1))
    first = find(r"\s*[：:=＝]\s*(.+)")
    return strip(F.when(first != "", first).otherwise(find(r"\s+(\S+)")))


def sanitise(x: Column) -> Column:
    """FN-53."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), vocab.ZERO_WIDTH, "")


def safe_filename(x: Column) -> Column:
    """FN-54."""
    base = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)([^/]*)$", 1)
    clean = F.regexp_replace(F.replace(F.replace(base, F.lit("\x00"), F.lit("")), F.lit("..\\"), F.lit("")), r"[/\\]\.\.", "")
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"[\x00-\x1F\x7F]", ""), r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    stem = F.upper(F.regexp_replace(named, r"(?<=.)\.[^.]*$", ""))
    return let(F.when(stem.isin(vocab.RESERVED_NAMES), F.concat(F.lit("_"), named)).otherwise(named), lambda n: F.when(n == "", "untitled").otherwise(n))


def magic_type(content: Column) -> Column:
    """FN-60: extensions that the first bytes stand for; an empty array if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.array().cast("array<string>")
    for prefix, kinds in reversed(vocab.MAGIC_BYTES.items()):
        out = F.when(F.startswith(head, F.lit(prefix)), F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def parse_verdict(x: Column) -> Column:
    """FN-58: a model's JSON answer, code fences removed; text that is no JSON becomes a marked struct."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(x), r"^```(?:json)?", ""), r"```$", ""))
    schema = "analysis string, risk_items array<struct<description:string,severity:string,word_text:string,pdf_text:string,risk_type:string>>, summary string, confidence double"
    parsed = F.from_json(bare, schema)
    failed = F.struct(F.left(x, F.lit(500)).alias("analysis"), F.array().cast("array<struct<description:string,severity:string,word_text:string,pdf_text:string,risk_type:string>>").alias("risk_items"), F.lit("解析失败").alias("summary"), F.lit(0.0).alias("confidence"))
    return F.when(parsed.isNotNull() & (parsed["analysis"].isNotNull() | parsed["summary"].isNotNull()), parsed).otherwise(failed)

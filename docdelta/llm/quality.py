"""Operator 5: line-first quality rules, in DataFrame functions only.

Lines are judged one by one (punctuation, symbols, shouting, navigation, boilerplate); the failing ones are removed, and
a document that loses too much of its text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: A line fails with this share of symbols to its letters, or so many words of capitals.
SYMBOL_SHARE, SHOUTED_WORDS = 0.08, 4
#: Words of capitals in a row. It starts at a word's first letter and never tries a word again, so its time is linear.
SHOUTING = r"(?<!\p{Lu})(?:\p{Lu}{2,}+[^\p{L}]++){%d}" % SHOUTED_WORDS
#: Punctuation: a line of LONG_LINE words fails without a mark that ends or divides sentences, any line with a run of marks.
LONG_LINE, MARK, MARK_RUN = 30, "[.!?…:;。！？]", r"[.…_=~-]{5}|[!?]{4}"
#: What prose ends a line with.
ENDING = rf"""[.!?…:;,。！？)\]"'»”’][{SPACE}]*$"""
#: Navigation: three separators between items; a lone word of a menu; a few capitalised words that end like no prose.
SEPARATORS, ITEM_SEPARATORS = "|»›•·→", 3
MENU = r"^\W*(?:home|menu|search|next|previous|contact(?: us)?|about(?: us)?|log ?in|sign (?:in|up)|register|faq|sitemap|share|print|startseite|suche|kontakt|accueil|recherche|inicio|buscar|contacto)\W*$"
ITEMS = rf"^(?:\p{{Lu}}\p{{Ll}}[^{SPACE}]*[{SPACE}]+){{1,11}}\p{{Lu}}\p{{Ll}}[^{SPACE}]*[{SPACE}]*$"
#: Phrases of boilerplate, in lower case. A line fails that consists of them by this share, or that begins
#: with one and has no more than so many words.
PHRASES = [
    "all rights reserved", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "copyright", "©", "(c) 19", "(c) 20",
    "cookie policy", "cookie notice", "cookie settings", "accept cookies", "accept all cookies", "cookie-einstellungen", "politique de cookies", "política de cookies",
    "privacy policy", "datenschutzerklärung", "politique de confidentialité", "política de privacidad", "terms of use", "terms of service", "terms and conditions", "nutzungsbedingungen", "mentions légales", "aviso legal",
    "licensed under", "creative commons", "subscribe to", "subscribe now", "sign in", "sign up", "share this", "share on", "click here", "read more", "weiterlesen", "lire la suite", "leer más",
    "skip to content", "skip to main content", "back to top", "powered by",
]
PHRASE_SHARE, PHRASE_WORDS = 0.2, 12
#: Each phrase holds one of these; a text without any needs no search for phrases.
PHRASE_PARTS = [
    "right", "rechte vorb", "droits r", "derechos", "©", "(c) ", "cookie", "privacy p", "datenschutze", "de confidentialit", "de privacidad", "terms ", "nutzungsb", "mentions l", "aviso l", "licensed u",
    "creative c", "subscribe ", "sign in", "sign up", "share ", "click h", "read m", "weiterl", "lire la", "leer m", "skip to", "back to t", "powered b",
]
_PHRASE = "|".join(re.escape(p) for p in sorted(PHRASES, key=len, reverse=True)).replace(r"\ ", " ")
#: A document is rejected if removed lines held more than this share of its words, or it shrinks below MIN_WORDS.
MAX_LOST, MIN_WORDS, MAX_REPEATED = 0.5, 10, 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words that lie in a 5-word window found at least twice, all its places counted. ``w``: a column of words."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    windows = _let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5)))))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _let(placed, lambda p: F.filter(p, lambda s, k: (F.get(p, k - 1)["h"] == s["h"]) | F.coalesce(F.get(p, k + 1)["h"] == s["h"], F.lit(False))))
        places = F.array_sort(F.transform(twice, lambda s: s["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
            lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(a["upto"], i)).alias("n"), (i + 5).alias("upto")), lambda a: a["n"],
        )

    some = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) >= 6, some).otherwise(0).cast("bigint")


def _has(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def hints(text: Column) -> Column:
    """struct(phrases, separators): whether any line can hold a phrase of boilerplate, or a separator."""
    return F.struct(_let(F.lower(text), lambda low: _has(low, PHRASE_PARTS)).alias("phrases"), _has(text, list(SEPARATORS)).alias("separators"))


def line_fails(line: Column, hint: Column) -> Column:
    """Whether a line with words is removed; ``hint``: :func:`hints` of its text, which spare searches."""
    n = F.length(line)
    symbols = n - F.length(_drop(line, SYMBOLS))
    low = F.lower(line)
    consists = n - F.length(F.regexp_replace(low, _PHRASE, "")) >= F.lit(PHRASE_SHARE) * n
    begins = F.rlike(low, F.lit(rf"^\W*(?:{_PHRASE})")) & (F.size(words(line)) <= PHRASE_WORDS)
    return (
        (symbols > F.lit(SYMBOL_SHARE) * n)
        | (~F.rlike(line, F.lit(MARK)) & (F.size(words(line)) >= LONG_LINE))
        | F.rlike(line, F.lit(MARK_RUN))
        | (hint["separators"] & (n - F.length(_drop(line, SEPARATORS)) >= ITEM_SEPARATORS))
        | ((F.rlike(line, F.lit(ITEMS)) | F.rlike(low, F.lit(MENU))) & ~F.rlike(line, F.lit(ENDING)))
        | ((F.upper(line) == line) & (low != line) & F.rlike(line, F.lit(SHOUTING)))
        | (hint["phrases"] & (consists | begins))
    )


def _judged(docs: DataFrame, id_col: str | None, text_col: str, carried: Column) -> DataFrame:
    """doc_id, text, carried, the counts, base_failed, kept and n_lines_removed of every row."""
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    base = docs.select((column(id_col) if id_col else F.lit(None)).alias("doc_id"), text.alias("text"), carried.alias("carried"))
    with_arrays = base.withColumns({"w": words(F.col("text")), "l": F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))})
    counted = with_arrays.select(
        "doc_id", "text", "carried",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(_drop(F.col("text"), " \t\n\x0b\x0c\r")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_drop(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        _let(hints(F.col("text")), lambda hint: F.filter("l", lambda x: line_fails(x, hint))).alias("failing"),
    )
    lost = F.aggregate("failing", F.lit(0).cast("bigint"), lambda a, x: a + F.size(words(x)))
    judged = counted.select("*", lost.alias("lost"), ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"))
    kept = ~F.col("base_failed") & (F.col("lost") <= F.lit(MAX_LOST) * F.col("n_words")) & (F.col("n_words") - F.col("lost") >= MIN_WORDS)
    return judged.withColumns({"kept": kept, "n_lines_removed": F.size("failing").cast("bigint")})


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """The counts, base verdict and verdict of every row; with ``cleaned`` also ``cleaned``, the text that is left.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed.
    A null text has no words and fails; so does an empty one. Null ids stay null; repeated rows are judged each; other
    columns, whatever their names, are left out; an empty table gives no rows.
    ``kept`` is false if base_failed, if the removed lines held more than MAX_LOST of the words, or if fewer than
    MIN_WORDS stay. Lines without words stay. Lines of any length and whole texts are judged, in linear time. No shuffle
    and no Python; a row's arrays are of its own text's size.
    """
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed"]
    judged = _judged(docs, id_col, text_col, F.lit(None))
    return judged.select(*out, *([clean_text(F.col("text")).alias("cleaned")] if cleaned else []))


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and the text without its failing lines."""
    columns = docs.columns
    judged = _judged(docs, None, text_col, F.struct(*(column(c).alias(f"c{k}") for k, c in enumerate(columns)))).where("kept")
    text = F.when(F.col("n_lines_removed") > 0, clean_text(F.col("text"))).otherwise(F.col("text"))
    return judged.select(*((text if c == text_col else F.col("carried")[f"c{k}"]).alias(c) for k, c in enumerate(columns)))


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    kept = lambda hint: F.filter(F.split(text, "\n", -1), lambda x: ~(F.rlike(x, F.lit(f"[^{SPACE}]")) & line_fails(x, hint)))
    return F.array_join(_let(hints(text), kept), "\n")

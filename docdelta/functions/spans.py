"""Matches of a pattern with their places, in native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


def grouped_class(characters: str, size: int = 5) -> str:
    """A pattern's class of the characters, which are looked at only within the range of their group."""
    known = sorted(set(characters))
    groups = [known[k : k + size] for k in range(0, len(known), size)]
    return "[" + "".join(f"[{g[0]}-{g[-1]}&&[{''.join(g)}]]" for g in groups) + "]"


def spans(text: Column, pattern: str, *groups: int, needs: str | None = None) -> Column:
    """array<struct<raw, start, end, g1, g2, ...>> of all matches in order; places count from 0, ends are exclusive.

    The pieces between matches and the matches themselves give the places by one running sum. The text is searched
    once for matches and once for pieces; groups are read from the short matches (patterns must not look beyond them
    for their groups). Texts without ``needs``, a piece of text that every match has, are not searched.
    """

    def build(found: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        ends = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        group = lambda m: [F.regexp_extract(m, pattern, g).alias(f"g{k + 1}") for k, g in enumerate(groups)]
        return let(ends, lambda e: F.transform(found, lambda m, i: F.struct(m.alias("raw"), (F.get(e, i + 1) - F.length(m)).alias("start"), F.get(e, i + 1).alias("end"), *group(m))))

    none = F.array().cast("array<struct<raw:string,start:int,end:int" + "".join(f",g{k + 1}:string" for k in range(len(groups))) + ">>")
    search = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, build(found)).otherwise(none))
    return search if needs is None else F.when(F.contains(text, F.lit(needs)), search).otherwise(none)


def places(text: Column, word: str) -> Column:
    """array<int> of the places of a word, from 0, as :func:`spans` finds it. Texts with it once are not searched by pattern."""
    first = F.locate(word, text)
    again = F.position(F.lit(word), text, first + len(word)) > 0
    every = F.transform(spans(text, r"\Q" + word + r"\E"), lambda s: s["start"])
    return F.when(first > 0, F.when(again, every).otherwise(F.array(first - 1))).otherwise(F.array().cast("array<int>"))


def finds(text: Column, pattern: str, *groups: int, needs: str | None = None, looks: str | None = None) -> Column:
    """:func:`spans` without places, as array<struct<raw, g1, g2, ...>>: the text is searched once only, and not if it has
    nothing like ``looks``, a plainer pattern that every match has."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("raw"), *(F.regexp_extract(m, pattern, g).alias(f"g{k + 1}") for k, g in enumerate(groups))))
    none = F.array().cast("array<struct<raw:string" + "".join(f",g{k + 1}:string" for k in range(len(groups))) + ">>")
    if needs is None and looks is None:
        return found
    return F.when(F.contains(text, F.lit(needs)) if looks is None else F.rlike(text, F.lit(looks)), found).otherwise(none)


def tokens(text: Column, pattern: str) -> Column:
    """array<struct<raw, start, end, before, after>> of all matches in order, with the text between each and its neighbours.
    The text is searched once for matches and once for what lies between them."""

    def build(found: Column, gaps: Column) -> Column:
        ends = F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return let(ends, lambda e: F.transform(found, lambda m, i: F.struct(m.alias("raw"), (F.get(e, i + 1) - F.length(m)).alias("start"), F.get(e, i + 1).alias("end"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))))

    none = F.array().cast("array<struct<raw:string,start:int,end:int,before:string,after:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: build(found, gaps))).otherwise(none))


def context(text: Column, start: Column, end: Column, left: int, right: int) -> Column:
    """The text around a span, stripped."""
    first = F.greatest(start - left, F.lit(0))
    return strip(F.substr(text, first + 1, end + right - first))


def disjoint(found: Column) -> Column:
    """Those spans, in order, that overlap none kept before (FN-21)."""
    empty = F.filter(found, lambda s: F.lit(False))
    return F.aggregate(found, empty, lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), kept).otherwise(F.array_append(kept, s)))

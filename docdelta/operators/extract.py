"""Field extraction (FN-10 to FN-24): one array of structs a family, exploded to rows.

Every function takes a table with a text column and returns its key columns with a row for each field, in the
order of extraction (``ord`` from 0). Texts are to be normalised before (:func:`docdelta.functions.text.normalise`).
No shuffle: all families are expressions over one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.spans import context, disjoint, finds, grouped_class, places, spans, tokens


def _rows(docs: DataFrame, found: Column, *fields: Column) -> DataFrame:
    keys = [c for c in docs.columns if c != "text"]
    return docs.select("*", F.posexplode(found).alias("ord", "s")).select(*keys, "ord", *fields)


def _s(*names: str) -> list[Column]:
    return [F.col("s")[n].alias(n) for n in names]


#: Which number between the character before it and the two after it is a field: one of 3 to 12 digits, no neighbour of a
#: letter, no clause or figure number, neither 1.0 nor a figure below ten with one decimal.
_NUMBER_KEPT = (
    r"(?s)\A(?![A-Za-z附图表章节号]\x00\d|第\x00[\d,.]+\x00.?[条款项]|[第条]\x00[\d,.]+\x00[号条]|.?\x00[\d,.]+\x00[A-Za-z]|.?\x00(?:[0,]*1\.0+|0?\d\.\d)\x00)"
    r".?\x00(?:\d[,.]?){3,12}\x00"
)


def number_tokens(text: Column) -> Column:
    """All numbers with what lies between them, on which FN-10 and FN-13 rest."""
    return tokens(text, vocab.NUMBER)


def number_places(found: Column) -> Column:
    """Those of the :func:`number_tokens` that FN-10 takes."""
    nul = F.lit("\x00")
    keep = lambda s: (F.length(s["raw"]) >= 3) & F.rlike(F.concat(F.right(s["before"], F.lit(1)), nul, s["raw"], nul, F.left(s["after"], F.lit(2))), F.lit(_NUMBER_KEPT))
    return F.filter(found, keep)


def number_items(text: Column, found: Column | None = None) -> Column:
    """FN-10 as array<struct<raw, value, context>>; ``found`` are the text's :func:`number_tokens`, if they are at hand."""
    item = lambda s: F.struct(s["raw"].alias("raw"), T.number(s["raw"]).alias("value"), context(text, s["start"], s["end"], 30, 30).alias("context"))
    return F.transform(number_places(number_tokens(text) if found is None else found), item)


def numbers(docs: DataFrame) -> DataFrame:
    """FN-10: numbers of 3 to 12 digits that are no codes, clause or figure numbers."""
    return _rows(docs, number_items(F.col("text")), *_s("raw", "value", "context"))


def _first_norms(found: Column) -> Column:
    """Of finds with their norm those that have one, each norm once."""
    return T.let(F.filter(found, lambda s: s["norm"].isNotNull()), lambda all_: T.let(F.transform(all_, lambda x: x["norm"]), lambda norms: F.filter(all_, lambda s, i: F.array_position(norms, s["norm"]) == i + 1)))


def date_items(text: Column) -> Column:
    """FN-11 as array<struct<raw, start, end, norm>>."""
    return _first_norms(F.concat(*(F.transform(spans(text, p), lambda s: F.struct(s["raw"].alias("raw"), s["start"].alias("start"), s["end"].alias("end"), T.normalise_date(s["raw"]).alias("norm"))) for p in vocab.DATE_PATTERNS)))


def date_norms(text: Column) -> Column:
    """FN-11 without places, as array<struct<raw, norm>>: a text that stands twice is normalised once.

    What the fourth pattern finds the second one has found: it is the second without blanks, and no two finds overlap.
    """
    return _first_norms(F.transform(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in vocab.DATE_PATTERNS[:3]))), lambda r: F.struct(r.alias("raw"), T.normalise_date(r).alias("norm"))))


def dates(docs: DataFrame) -> DataFrame:
    """FN-11: each normalised date once, at its first place in pattern order (AGG-13)."""
    return _rows(docs, date_items(F.col("text")), *_s("raw", "norm"), context(F.col("text"), F.col("s")["start"], F.col("s")["end"], 20, 20).alias("context"))


#: The pattern of amounts in words with its characters in groups by code point: most others are told by the groups' ends.
_WORDS = grouped_class(vocab.AMOUNT_WORDS[1:-2]) + "+"


def _valid_words(raw: Column) -> Column:
    return (F.length(raw) >= 4) & F.rlike(raw, F.lit("[元圆]")) & ~F.startswith(raw, F.lit("零")) & ~F.contains(raw, F.lit("零零零")) & F.rlike(raw, F.lit("[壹贰叁肆伍陆柒捌玖拾佰仟万亿]"))


def word_items(text: Column) -> Column:
    """FN-12 with FN-22 as array<struct<raw, start, end>>."""
    return F.filter(spans(text, _WORDS), lambda s: _valid_words(s["raw"]))


def word_texts(text: Column) -> Column:
    """FN-12 with FN-22 without places, as array<string>."""
    return F.filter(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), _valid_words)


def amount_words(docs: DataFrame) -> DataFrame:
    """FN-12 with FN-22."""
    return _rows(docs, word_items(F.col("text")), *_s("raw"), context(F.col("text"), F.col("s")["start"], F.col("s")["end"], 20, 20).alias("context"))


def amount_items(text: Column, keywords: list[str] | None = None, found: Column | None = None, phrases: bool = False) -> Column:
    """FN-13 as array<struct<shape, start, end, raw, keyword, left>> and, with ``phrases``, phrase; ``found`` as in :func:`number_items`.

    All six shapes end with a number, before which they look back as far as the number before it at most, as no label has
    digits. So numbers are found once, with the text between them, and a shape is a pattern for the end of a gap. A shape is
    a label and then signs of ``vocab.AMOUNT_SIGNS`` only, so of a gap its last such signs and as many characters as the
    longest label has are looked at. Numbers without any label are dropped before anything else is worked out, and
    keywords and phrases are read for the spans that are kept. What every head of a shape has (``vocab.AMOUNT_NEEDS``) is
    looked for before its pattern.
    """
    words = keywords or vocab.AMOUNT_KEYWORDS
    label, longest = f"({'|'.join(re.escape(k) for k in words)})", max(3, *map(len, words))
    near = lambda gap: F.right(gap, F.length(gap) - F.length(F.rtrim(gap, F.lit(vocab.AMOUNT_SIGNS))) + longest)
    marked = lambda s: T.let(F.translate(s["raw"], ",.", ""), lambda d: F.struct(*(s[c].alias(c) for c in ("raw", "start", "end")), near(s["before"]).alias("before"), F.length(F.regexp_extract(s["after"], r"^\s*元", 0)).alias("unit"), (F.length(d).between(3, 12) & (d.cast("double") >= 100)).alias("valid")))

    endings = [pattern.replace("LABEL", label) + r"\z" for pattern, _ in vocab.AMOUNT_SHAPES]
    may = lambda k, s: F.rlike(s["before"], F.lit(vocab.AMOUNT_NEEDS[k])) if k == len(endings) - 1 else F.contains(s["before"], F.lit(vocab.AMOUNT_NEEDS[k]))
    span = lambda k, s, head, end: F.struct(F.lit(k).alias("shape"), (s["start"] - F.length(head)).alias("start"), end.alias("end"), s["raw"].alias("raw"), head.alias("head"))

    def free(k: int, found: Column, with_unit: bool) -> Column:
        """A shape whose finds cannot overlap each other."""
        fits = F.filter(found, lambda s: s["valid"] & ((s["unit"] > 0) if with_unit else F.lit(True)) & may(k, s) & F.rlike(s["before"], F.lit(endings[k])))
        return F.transform(fits, lambda s: span(k, s, F.regexp_extract(s["before"], endings[k], 0), s["end"] + s["unit"] if with_unit else s["end"]))

    def in_turn(k: int, found: Column) -> Column:
        """A shape whose last sign may be the label of the next find: what one find has used, the next cannot."""
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<shape:int,start:int,end:int,raw:string,head:string>>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gone = F.greatest(a["used"] - s["start"] + F.length(s["before"]), F.lit(0))
            head = F.regexp_extract(F.substr(s["before"], gone + 1), endings[k], 0)
            told = lambda h, end: F.struct(end.alias("used"), F.when(s["valid"], F.array_append(a["out"], span(k, s, h, end))).otherwise(a["out"]).alias("out"))
            return T.let(head, lambda h: F.when(h != "", told(h, s["end"] + s["unit"])).otherwise(a))

        return F.aggregate(F.filter(found, lambda s: (s["unit"] > 0) & may(k, s)), start, step, lambda a: a["out"])

    def item(s: Column) -> Column:
        """What is told of a span that is kept."""
        lead = lambda n: F.greatest(s["start"] - n, F.lit(0))
        around = T.strip(F.substr(text, lead(30) + 1, s["start"] - lead(30)))
        by_label = F.coalesce(*(F.when(s["shape"] == k, F.regexp_extract(s["head"], e, 1)) for k, e in enumerate(endings)))
        named = lambda t, p: T.let(F.regexp_extract(t, p, 1), lambda g: F.when(g != "", g))
        keyword = F.when(s["shape"] != vocab.SYMBOL_SHAPE, by_label).otherwise(T.let(around, lambda t: F.coalesce(*(named(t, p) for p in vocab.SYMBOL_LABELS), by_label)))
        phrase = lambda: F.when(s["shape"] != vocab.SYMBOL_SHAPE, F.substr(text, s["start"] + 1, s["end"] - s["start"])).otherwise(T.strip(F.substr(text, lead(10) + 1, s["end"] + 10 - lead(10))))
        left = F.when(s["shape"] == vocab.SYMBOL_SHAPE, 50).otherwise(30)
        return F.struct(*(s[c].alias(c) for c in ("shape", "start", "end", "raw")), keyword.alias("keyword"), *([phrase().alias("phrase")] if phrases else []), left.alias("left"))

    some = rf"(?:{label}|人民币|RMB|[¥＄$])[{vocab.AMOUNT_SIGNS}]*\z"

    def shapes(found: Column) -> Column:
        each = [in_turn(k, found) if with_unit and "LABEL" in pattern else free(k, found, with_unit) for k, (pattern, with_unit) in enumerate(vocab.AMOUNT_SHAPES)]
        return F.transform(disjoint(F.concat(*each)), item)

    all_ = number_tokens(text) if found is None else found
    if all(words):  # a gap before an amount ends with a sign or the last character of a label
        last = F.lit("".join({w[-1] for w in [*words, "人民币", "RMB", *"¥＄$", *vocab.AMOUNT_SIGNS]}))
        all_ = F.filter(all_, lambda s: F.contains(last, F.right(s["before"], F.lit(1))))
    return T.let(F.filter(F.transform(all_, marked), lambda s: F.rlike(s["before"], F.lit(some))), shapes)


def amount_context(text: Column, s: Column) -> Column:
    first = F.greatest(s["start"] - s["left"], F.lit(0))
    return T.strip(F.substr(text, first + 1, s["end"] + 20 - first))


def amounts(docs: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """FN-13: amounts in digits by six patterns in order of precision; a span that overlaps an earlier one is dropped."""
    return _rows(docs, amount_items(F.col("text"), keywords, phrases=True), *_s("shape", "raw"), T.number(F.col("s")["raw"]).alias("value"), *_s("keyword", "phrase"), amount_context(F.col("text"), F.col("s")).alias("context"))


def percentage_items(text: Column) -> Column:
    """FN-14 as array<struct<raw, start, end, g1>>."""
    return spans(text, vocab.PERCENTAGE, 1, needs="%")


def percentage_texts(text: Column) -> Column:
    """FN-14 without places, as array<string> of the figures before the sign."""
    return F.when(F.contains(text, F.lit("%")), F.regexp_extract_all(text, F.lit(vocab.PERCENTAGE), F.lit(1))).otherwise(F.array().cast("array<string>"))


def percentages(docs: DataFrame) -> DataFrame:
    """FN-14."""
    return _rows(docs, percentage_items(F.col("text")), *_s("raw"), (F.col("s")["g1"].cast("double") / 100).alias("value"), context(F.col("text"), F.col("s")["start"], F.col("s")["end"], 20, 20).alias("context"))


def party_items(text: Column) -> Column:
    """FN-15 as array<struct<raw, party, name>>."""
    first, second, third = (F.transform(finds(text, p, 1, 2, looks=n), lambda s: F.struct(s["raw"].alias("raw"), s["g1"].alias("party"), T.strip(s["g2"]).alias("name"))) for p, n in zip(vocab.PARTY_SHAPES, vocab.PARTY_NEEDS))
    return F.aggregate(third, F.concat(first, second), lambda a, s: F.when(F.exists(a, lambda k: (k["party"] == s["party"]) & (k["name"] == s["name"])), a).otherwise(F.array_append(a, s)))


def parties(docs: DataFrame) -> DataFrame:
    """FN-15: label and organisation after a colon, in brackets, or after a blank unless found before (AGG-15)."""
    return _rows(docs, party_items(F.col("text")), *_s("raw", "party", "name"))


def contract_number_items(text: Column) -> Column:
    """FN-16 as array<struct<shape, raw, norm>>."""
    trim = lambda c: F.regexp_replace(c, r"\.+$", "")
    row = lambda k, raw, norm: F.struct(F.lit(k).alias("shape"), raw.alias("raw"), norm.alias("norm"))
    first = F.filter(F.transform(finds(text, vocab.CONTRACT_NUMBERS[0], 1, needs="合同编号"), lambda s: row(0, trim(s["raw"]), trim(s["g1"]))), lambda s: F.length(s["norm"]) >= 2)
    second = F.filter(F.transform(finds(text, vocab.CONTRACT_NUMBERS[1], 1), lambda s: row(1, s["raw"], s["g1"])), lambda s: F.length(F.translate(s["norm"], "-_./", "")) >= 3)
    third = F.transform(finds(text, vocab.CONTRACT_NUMBERS[2], 1, needs="编号"), lambda s: row(2, s["raw"], s["g1"]))
    return F.concat(first, second, third)


def contract_numbers(docs: DataFrame) -> DataFrame:
    """FN-16."""
    return _rows(docs, contract_number_items(F.col("text")), *_s("shape", "raw", "norm"))


def clause_items(text: Column) -> Column:
    """FN-17 as array<struct<raw, clause_type, clause_num, title>>."""

    def item(s: Column) -> Column:
        kind = F.when(F.contains(s["g1"], F.lit("章")), "章").when(F.contains(s["g1"], F.lit("节")), "节").otherwise("条")
        return F.struct(s["raw"].alias("raw"), kind.alias("clause_type"), F.replace(F.replace(s["g1"], F.lit("第"), F.lit("")), kind, F.lit("")).alias("clause_num"), T.strip(s["g2"]).alias("title"))

    return F.transform(finds(text, vocab.CLAUSE, 1, 2, needs="第"), item)


def clause_titles(text: Column) -> Column:
    """FN-17 as array<struct<raw, title>>, by one search for each."""
    every = lambda g: F.regexp_extract_all(text, F.lit(vocab.CLAUSE), F.lit(g))
    found = F.zip_with(every(0), every(2), lambda raw, title: F.struct(raw.alias("raw"), T.strip(title).alias("title")))
    return F.when(F.contains(text, F.lit("第")), found).otherwise(F.array().cast("array<struct<raw:string,title:string>>"))


def clauses(docs: DataFrame) -> DataFrame:
    """FN-17."""
    return _rows(docs, clause_items(F.col("text")), *_s("raw", "clause_type", "clause_num", "title"))


def legal_term_items(text: Column) -> Column:
    """FN-18 as array<struct<raw, category, context>>."""
    pairs = [(c, w) for c, words in vocab.LEGAL_TERMS.items() for w in words]

    def term(category: str, word: str) -> Column:
        return F.transform(places(text, word), lambda s: F.struct(F.lit(word).alias("raw"), F.lit(category).alias("category"), context(text, s, s + len(word), 40, 40).alias("context")))

    found = F.concat(*(term(c, w) for c, w in pairs))
    ordered = F.transform(F.array_sort(F.transform(found, lambda s, i: F.struct((-F.length(s["raw"])).alias("n"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
    return F.aggregate(ordered, F.filter(found, lambda s: F.lit(False)), lambda a, s: F.when(F.exists(a, lambda k: (k["category"] == s["category"]) & (F.left(k["context"], F.lit(20)) == F.left(s["context"], F.lit(20)))), a).otherwise(F.array_append(a, s)))


def legal_terms(docs: DataFrame) -> DataFrame:
    """FN-18: of one category's terms with the same beginning of context the longest stays (AGG-14)."""
    return _rows(docs, legal_term_items(F.col("text")), *_s("raw", "category", "context"))


def contact_items(text: Column) -> Column:
    """FN-19a to c as array<struct<kind, raw, norm>>."""
    row = lambda kind, raw, norm: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), norm.alias("norm"))
    mobile = F.transform(finds(text, vocab.CONTACT_MOBILE, looks=r"1[3-9]\d{9}"), lambda s: row("mobile", s["raw"], s["raw"]))
    landline = F.transform(finds(text, vocab.CONTACT_LANDLINE, 1, looks=r"\d[- ]\d{7}"), lambda s: row("landline", s["g1"], F.translate(s["g1"], " ", "-")))
    email = F.filter(F.transform(finds(text, vocab.CONTACT_EMAIL, needs="@"), lambda s: row("email", s["raw"], F.lower(s["raw"]))), lambda s: ~F.rlike(s["raw"], F.lit(r"^\d+@\d+")))
    return F.concat(mobile, landline, email)


def contacts(docs: DataFrame) -> DataFrame:
    """FN-19a to c."""
    return _rows(docs, contact_items(F.col("text")), *_s("kind", "raw", "norm"))


def duration_items(text: Column) -> Column:
    """FN-19d as array<struct<raw, term_type, norm>>."""
    pairs = [(c, w) for c, words in vocab.DURATION_TERMS.items() for w in words]

    def term(kind: str, word: str) -> Column:
        return F.transform(finds(text, rf"{re.escape(word)}\s*[:：]?\s*([^\n\r。；;\.]{{1,60}})", 1, needs=word), lambda s: F.struct(s["raw"].alias("raw"), F.lit(kind).alias("term_type"), F.regexp_replace(s["g1"], "^[.,;；:： ]+|[.,;；:： ]+$", "").alias("norm")))

    return F.filter(F.concat(*(term(c, w) for c, w in pairs)), lambda s: s["norm"] != "")


def durations(docs: DataFrame) -> DataFrame:
    """FN-19d: overlapping keywords give a row each."""
    return _rows(docs, duration_items(F.col("text")), *_s("raw", "term_type", "norm"))


#: What a text has by family, as arrays of structs; those of numbers and amounts come from its number tokens.
FAMILIES = {
    "numbers": lambda text, found: F.transform(number_places(found), lambda s: F.struct(s["raw"].alias("raw"), T.number(s["raw"]).alias("value"))), "dates": date_norms, "amounts_words": lambda text: F.transform(word_texts(text), lambda x: F.struct(x.alias("raw"))), "amounts_digits": lambda text, found: amount_items(text, None, found),
    "percentages": lambda text: F.transform(percentage_texts(text), lambda x: F.struct(F.concat(x, F.lit("%")).alias("raw"), (x.cast("double") / 100).alias("value"))), "party_names": party_items, "contract_numbers": contract_number_items,
    "clauses": clause_titles, "legal_terms": legal_term_items, "contact_info": contact_items, "terms": duration_items,
}
_NORMS = {"dates": "norm", "party_names": "name", "contract_numbers": "norm", "clauses": "title", "legal_terms": "category", "contact_info": "norm", "terms": "norm"}


def extract_all(docs: DataFrame) -> DataFrame:
    """FN-23: all families in long form: the keys, family, ord, raw, norm, value. A text is rendered and read once."""
    keys = [c for c in docs.columns if c != "text"]
    text, found = F.col("text"), F.col("__numbers")

    def rows(family: str, run) -> Column:
        number = {"numbers": lambda s: s["value"], "percentages": lambda s: s["value"], "amounts_digits": lambda s: T.number(s["raw"])}.get(family, lambda s: F.lit(None).cast("double"))
        items = run(text, found) if family in ("numbers", "amounts_digits") else run(text)
        return F.transform(items, lambda s, i: F.struct(F.lit(family).alias("family"), i.alias("ord"), s["raw"].alias("raw"), s[_NORMS.get(family, "raw")].alias("norm"), number(s).alias("value")))

    counted = docs.where(text.isNotNull()).select(*keys, "text", number_tokens(text).alias("__numbers"))
    return counted.select(*keys, F.inline(F.concat(*(rows(f, run) for f, run in FAMILIES.items()))))

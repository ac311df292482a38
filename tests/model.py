"""Fields of a pair of texts read and matched by plain code (FN-10 to FN-14, JN-01 to JN-06), to hold the library against."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from docdelta.functions import vocab

_HAN = "[一-鿿]"
_NUMBER, _DATES, _WORDS = re.compile(vocab.NUMBER), [re.compile(p) for p in vocab.DATE_PATTERNS], re.compile(vocab.AMOUNT_WORDS)
_PERCENT, _LETTER, _RUNS = re.compile(r"(\d+(?:\.\d+)?)%"), re.compile("[A-Za-z]"), re.compile(_HAN + "{2,}")
_MONEY_LABEL, _LABEL = re.compile(rf"({_HAN}*(?:费用|金额|总价|总额|合计|包干){_HAN}*)$"), re.compile(rf"({_HAN}+)$")
_BARE = re.compile(r"[^\w一-鿿]")
_KW = "|".join(map(re.escape, vocab.AMOUNT_KEYWORDS))
#: The shapes of an amount in order of precision, with the context before it.
_AMOUNTS = [
    (re.compile(rf"({_KW})\s*为\s*[¥＄$]?\s*({vocab.NUMBER})\s*元"), 30), (re.compile(rf"(人民币)\s*({vocab.NUMBER})\s*元"), 30), (re.compile(rf"(RMB)\s*({vocab.NUMBER})"), 30),
    (re.compile(rf"({_KW})\s*({vocab.NUMBER})\s*元"), 30), (re.compile(rf"([¥＄$])\s*({vocab.NUMBER})"), 50), (re.compile(rf"({_KW})\s*[:：]?\s+({vocab.NUMBER})"), 30),
]
_NO_DIGITS = str.maketrans("", "", ",.")


def _around(text: str, start: int, end: int, left: int, right: int) -> str:
    return text[max(start - left, 0) : end + right].strip()


def numbers(text: str) -> list[tuple[str, float, set[str]]]:
    """FN-10: (raw, value, runs of Han characters around it)."""
    out = []
    for m in _NUMBER.finditer(text):
        raw, start, end = m[0], m.start(), m.end()
        if not 3 <= len(raw.translate(_NO_DIGITS)) <= 12:
            continue
        value, prev, after = float(raw.replace(",", "")), text[max(start - 1, 0) : start], text[end : end + 2]
        whole, _, part = raw.replace(",", "").partition(".")
        if _LETTER.search(prev + after[:1]) or value == 1.0 and "." in raw or prev == "第" and any(c in after for c in "条款项"):
            continue
        if prev in {"附", "图", "表", "章", "节", "号"} or after[:1] in {"号", "条"} and prev in {"第", "条"} or len(part) == 1 and len(whole) <= 2 and value < 10:
            continue
        out.append((raw, value, set(_RUNS.findall(_around(text, start, end, 30, 30)))))
    return out


def dates(text: str) -> list[str]:
    """FN-11, FN-30: each date once as YYYY-MM-DD, at its first place in pattern order."""
    found: dict[str, None] = {}
    for pattern in _DATES:
        for m in pattern.finditer(text):
            parts = re.sub("[日号]", "", re.sub("[年/.月]", "-", m[0])).strip("-").split("-")
            if len(parts) == 3:
                found["-".join(p if k == 0 else p.rjust(2, "0") for k, p in enumerate(parts))] = None
    return list(found)


def amount_words(text: str) -> list[str]:
    """FN-12 with FN-22."""
    return [w for w in _WORDS.findall(text) if len(w) >= 4 and re.search("[元圆]", w) and not w.startswith("零") and "零零零" not in w and re.search("[壹贰叁肆伍陆柒捌玖拾佰仟万亿]", w)]


def amounts(text: str) -> list[tuple[str, float, str, set[str]]]:
    """FN-13, FN-21: (raw, value, bare keyword, amount words around it); earlier shapes keep their places."""
    taken, out = [], []
    for k, (pattern, left) in enumerate(_AMOUNTS):
        for m in pattern.finditer(text):
            raw, start, end = m[2], m.start(), m.end()
            digits = raw.translate(_NO_DIGITS)
            if not 3 <= len(digits) <= 12 or float(digits) < 100 or any(start < e and end > s for s, e in taken):
                continue
            taken.append((start, end))
            label = m[1]
            if k == 4:
                head = text[max(start - 30, 0) : start].strip()
                label = (_MONEY_LABEL.search(head) or _LABEL.search(head) or m)[1]
            near = _BARE.sub("", _around(text, start, end, left, 20)).lower()
            out.append((raw, float(raw.replace(",", "")), _BARE.sub("", label).lower(), {w for w in vocab.AMOUNT_CONTEXT if w in near}))
    return out


def percentages(text: str) -> list[float]:
    """FN-14."""
    return [float(x) / 100 for x in _PERCENT.findall(text)]


def _close(a: float, b: float) -> bool:
    return abs(a - b) <= max(vocab.RELATIVE_TOLERANCE * max(abs(a), abs(b)), vocab.ABSOLUTE_TOLERANCE)


def _by_value(word: list[str], pdf: list[str]) -> Iterator[tuple]:
    """JN-01, JN-02."""
    here, there = set(word), set(pdf)
    yield from (("matched" if x in there else "missing_in_pdf", k, x, None, None) for k, x in enumerate(word))
    yield from (("extra_in_pdf", k, x, None, None) for k, x in enumerate(pdf) if x not in here)


def _by_tolerance(word: list[float], pdf: list[float]) -> Iterator[tuple]:
    """JN-03."""
    near = lambda x, others: any(abs(x - o) < vocab.PERCENT_TOLERANCE for o in others)
    yield from (("matched" if near(x, pdf) else "missing_in_pdf", k, None, None, x) for k, x in enumerate(word))
    yield from (("extra_in_pdf", k, None, None, x) for k, x in enumerate(pdf) if not near(x, word))


def _greedy(word: list[tuple], pdf: list[tuple], accept: Callable[[tuple, tuple], bool]) -> Iterator[tuple]:
    """JN-04, JN-05: each word item in order takes the first free pdf item that fits."""
    free = dict(enumerate(pdf))
    for k, x in enumerate(word):
        hit = next((j for j, o in free.items() if accept(x, o)), None)
        yield ("missing_in_pdf", k, x[0], None, None) if hit is None else ("matched", k, x[0], free.pop(hit)[0], None)
    yield from (("extra_in_pdf", j, o[0], None, None) for j, o in free.items())


def _same_number(w: tuple, p: tuple) -> bool:
    return w[1] == p[1] or _close(w[1], p[1]) and not w[2].isdisjoint(p[2])


def _same_amount(w: tuple, p: tuple) -> bool:
    return w[2] != "" and w[2] == p[2] and _close(w[1], p[1]) or w[1] == p[1] and not w[3].isdisjoint(p[3])


#: Family → (extraction, matching), in the order of the summary.
FAMILIES = {
    "numbers": (numbers, lambda w, p: _greedy(w, p, _same_number)), "dates": (dates, _by_value), "amounts_words": (amount_words, _by_value),
    "amounts_digits": (amounts, lambda w, p: _greedy(w, p, _same_amount)), "percentages": (percentages, _by_tolerance),
}


def matched(word: str | None, pdf: str | None) -> list[tuple]:
    """(family, direction, ord, raw, other, value) of a pair."""
    return [(family, *found) for family, (extract, match) in FAMILIES.items() for found in match(extract(word or ""), extract(pdf or ""))]

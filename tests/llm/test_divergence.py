import random
import re
from collections import Counter

import pytest

from docdelta.llm import divergence


def brute(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        mine = [(s, w) for x, s, w in docs if x == lang]
        df = Counter(t for _, w in mine for t in set(w))
        kept = [t for t in df if df[t] >= 3]
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(t for t in w if df[t] >= 3)
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))  # noqa: E731, B023
        for s, c in counts.items():
            pairs = [(o, sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:200])):
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())))]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, odd, empty, monkeypatch, small):
    if small:  # counts passed on early, terms of more sources than a table holds, totals joined by shuffling
        monkeypatch.setattr(divergence, "GATHERED", 20)
        monkeypatch.setattr(divergence, "STRIDE", 3)
        monkeypatch.setattr(divergence, "TABLE", 4)
        monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    draw = random.Random(1)
    words = ["the", "The", "é", "Straße", "x1y", "a_b", "你好", "don't", *(f"w{chr(97 + k // 20)}{chr(97 + k % 20)}" for k in range(300))]
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    for k in range(220):
        text = " ".join(draw.choice(words[: 8 + 3 * (k % 90)]) for _ in range(draw.randrange(60)))
        rows.append((draw.choice(["en", "de", None, ""]), draw.choice([None, "", *(f"s{j}" for j in range(9))]), text))
    rows += [("xx", "a", "one two"), ("xx", "b", None), ("yy", "a", "!!"), ("zz", "a", "all the same"), ("zz", "a", "all the same"), ("zz", "b", "All The Same")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, source string, text string, n int, term string").repartition(4)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute(rows)
    assert divergence.audit(empty).count() == 0


def test_one_term_in_every_text(spark):
    rows = [("en", f"s{k % 3}", "same " * (k % 5)) for k in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute(rows)


def test_sort_tells_terms_apart_by_their_first_eight_bytes(spark):
    docs = spark.createDataFrame([("a language\0 of a long name", s, t) for s in ("a", "b") for t in ("one two", "two one two", "three")], "lang string, source string, text string")
    in_order = divergence._sorted(divergence._counted(divergence._named(docs, "lang", "source", "text")))
    first = in_order._jdf.queryExecution().executedPlan().toString().split("Sort [")[1].split("#")[0]
    found = [[bytes(r[first]) for r in part] for part in in_order.rdd.glom().collect()]
    assert all(part == sorted(part) for part in found)
    assert {key[:3] for part in found for key in part} == {b"one", b"two", b"thr"}


def test_language_with_zero_bytes(spark):
    rows = [(lang, s, t) for lang in ("x\0y", "x", "") for s in ("a", "b\0") for t in ("one two", "two one two", "three", "one three")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == brute(rows)

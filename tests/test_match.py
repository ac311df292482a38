import random
import re

from docdelta.functions import vocab
from docdelta.operators import match


def close(a, b):
    return abs(a - b) <= max(1e-5 * max(abs(a), abs(b)), 0.01)


def model(words, pdfs, accept):
    """The greedy matcher, item by item."""
    used, out = set(), []
    for w in words:
        hit = next((j for j, p in enumerate(pdfs) if j not in used and accept(w, p)), None)
        used |= {hit} - {None}
        out.append(("matched" if hit is not None else "missing_in_pdf", w["ord"], None if hit is None else pdfs[hit]["raw"]))
    return sorted([*out, *(("extra_in_pdf", p["ord"], None) for j, p in enumerate(pdfs) if j not in used)], key=str)


def numbers_accept(w, p):
    runs = lambda x: set(re.findall("[一-鿿]{2,}", x["context"]))
    return w["value"] == p["value"] or (close(w["value"], p["value"]) and bool(runs(w) & runs(p)))


def amounts_accept(w, p):
    kw = lambda k: re.sub(r"[^\w一-鿿]", "", k).lower()
    shared = any(c in kw(w["context"]) and c in kw(p["context"]) for c in vocab.AMOUNT_CONTEXT)
    return bool(kw(w["keyword"]) and kw(w["keyword"]) == kw(p["keyword"]) and close(w["value"], p["value"])) or (w["value"] == p["value"] and shared)


def test_greedy_against_the_model(spark):
    rng, rows = random.Random(11), []
    for pair in range(150):
        for side in ("word", "pdf"):
            for k in range(rng.randrange(7)):
                value = rng.choice([100.0, 100.005, 100.01, 200.0, 1e6, 1e6 + 0.01, 1e6 + 20])
                rows.append((pair, side, k, f"{side}{k}", value, rng.choice(["金额", "¥", "RMB ", "违约金:"]), rng.choice(["合同费用", "违约责任", "甲 乙", "金额总计"])))
    fields = spark.createDataFrame(rows, "pair_id bigint, side string, ord int, raw string, value double, keyword string, context string")
    by = {}
    for p, side, k, raw, value, keyword, context in rows:
        by.setdefault(p, {"word": [], "pdf": []})[side].append({"ord": k, "raw": raw, "value": value, "keyword": keyword, "context": context})
    for run, accept in ((match.match_numbers, numbers_accept), (match.match_amounts, amounts_accept)):
        got = {}
        for r in run(fields).collect():
            got.setdefault(r.pair_id, []).append((r.direction, r.ord, r.other))
        assert {p: sorted(v, key=str) for p, v in got.items()} == {p: m for p, v in by.items() if (m := model(v["word"], v["pdf"], accept))}


def test_sets_and_tolerance(spark):
    rows = [(1, "word", 0, "a", 0.05), (1, "word", 1, "a", 0.3), (1, "pdf", 0, "b", 0.0505), (1, "pdf", 1, "a", 0.052), (2, "pdf", 0, "z", 0.1)]
    fields = spark.createDataFrame(rows, "pair_id bigint, side string, ord int, norm string, value double")
    assert sorted((r.pair_id, r.direction, r.ord) for r in match.set_match(fields, "norm").collect()) == [(1, "extra_in_pdf", 0), (1, "matched", 0), (1, "matched", 1), (2, "extra_in_pdf", 0)]
    got = sorted((r.pair_id, r.direction, r.ord, r.other) for r in match.tolerance_match(fields).collect())
    assert got == [(1, "extra_in_pdf", 1, None), (1, "matched", 0, 0.0505), (1, "missing_in_pdf", 1, None), (2, "extra_in_pdf", 0, None)]


def test_yen_pairs_stay_apart(spark):
    """The same amount after a yen sign is reported on both sides unless an amount word stands near."""
    rows = [(1, s, 0, "270000.00", 270000.0, "¥", "即¥270000.00元") for s in ("word", "pdf")]
    fields = spark.createDataFrame(rows, "pair_id bigint, side string, ord int, raw string, value double, keyword string, context string")
    assert {r.direction for r in match.match_amounts(fields).collect()} == {"missing_in_pdf", "extra_in_pdf"}

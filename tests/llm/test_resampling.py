import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from docdelta.llm import resampling, simhash


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(rows, target):
    s = Counter(b for _, t in rows for b in features(t)[1])
    t = Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    out = []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(docs, target):
    return sorted((tuple(r) for r in resampling.resample(docs, target).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, odd, monkeypatch, small):
    if small:  # many blocks, texts in slices
        monkeypatch.setattr(resampling, "BLOCK_DOCS", 16)
        monkeypatch.setattr(simhash, "SLICE", 5)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(100 + k, " ".join(f"w{k * j % 97} Straße" for j in range(k % 40))) for k in range(150)]
    rows += [(300, "it " * 700), (301, "it " * 70_000), (301, "it " * 70_000)]
    target = ["the quick W3 straße", None, "", "Straße w5 w7 " * 40]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, score string, bucket int").repartition(5)
    assert found(docs, spark.createDataFrame([(t,) for t in target], "text string")) == brute(rows, target)


def test_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, empty) == brute(rows, [])
    assert found(empty, odd) == []


def test_names_of_any_kind(spark):
    docs = spark.createDataFrame([("a", "one two", 1), ("b", None, 2)], "`id.of` string, `a.b` string, doc int")
    out = resampling.resample(docs, docs, id_col="id.of", text_col="a.b", target_text_col="a.b")
    assert sorted((r.doc_id, r.n_features) for r in out.collect()) == [("a", 3), ("b", 0)]

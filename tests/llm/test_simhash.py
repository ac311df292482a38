import re

import pytest
import xxhash

from docdelta.llm import simhash
from docdelta.llm.components import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = {}
    for doc, text in rows:
        fps.setdefault(brute_fingerprint(text), []).append(doc)
    keys, root = list(fps), {k: k for k in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [d for d in fps[k] if d is not None]
        least[find(k)] = min([*ids, *([least[find(k)]] if least.get(find(k)) is not None else [])], default=None)
    return sorted(((d, f"{k:016x}", least[find(k)]) for k, ds in fps.items() for d in ds), key=str)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 3), (11, 11), (20, 21), (20, 22), (20, 23)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4, 20: 20, 21: 20, 22: 20, 23: 20}
    assert components(edges.limit(0)).count() == 0


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u bigint, v bigint")
    assert {r.root for r in components(edges).collect()} == {0}


def test_odd_rows(spark, odd, empty):
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1, 10_000])
def test_near_copies_against_brute_force(spark, monkeypatch, crowd):
    """Links by pairs of cells, by shared neighbours, and by both."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    base = [f"w{k * 7919 % 1009}" for k in range(400)]
    rows = [(1000 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 400, 3)]
    rows += [(k, " ".join(f"v{(k * 31 + j * j) % 997}" for j in range(30))) for k in range(100)] + [(5000 + k, "tiny text") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    wanted = brute_components(rows)
    assert got == wanted
    assert len({c for *_, c in wanted}) < len(rows) - 20


def test_links_at_two_bits_only(spark):
    a = 0x0123456789ABCDEF
    fps = [a, a ^ 0b11, a ^ (1 << 63) ^ 1, a ^ 0b111000, (a ^ 0b11) ^ (3 << 40)]
    signed = [x - (1 << 64) * (x >> 63) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert len({found[signed[k]] for k in (0, 1, 2, 4)}) == 1
    assert signed[3] not in found


@pytest.mark.parametrize("long", [False, True])
def test_fingerprint_in_slices(monkeypatch, long):
    text = " ".join(f"a{k * k % 577}" for k in range(3001)) + " " + "b" * (3000 if long else 1)
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_stage_keeps_one_of_each_group(spark, odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and None in ids and 7 in ids


def test_pairs_in_a_cell_are_verified(spark):
    """One cell, Manhattan distance 0, but 4 bits apart: proposed and rejected."""
    a, b = 0b001001, 0b010010
    assert simhash.links(spark.createDataFrame([(a,), (b,)], "fp bigint")).count() == 0


def test_hot_fingerprints(spark):
    """A text that a third of the rows have is labelled like any other."""
    rows = [(k, "the same words again and again") for k in range(50)] + [(100 + k, f"other {k * k} words {k} of row {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute_components(rows)

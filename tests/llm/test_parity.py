import random
import re

import numpy as np
import pytest

from docdelta.llm import parity
from docdelta.llm.queries import op11_parity


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute(rows):
    """(id, size, smallest id reachable) over all pairs of rows."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found(docs):
    return sorted((tuple(r) for r in parity.join_similar(docs).collect()), key=str)


def edited(words, *places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


@pytest.mark.parametrize("frequent", [parity.PASSAGES, 0])
def test_against_brute_force(spark, odd, empty, monkeypatch, frequent):
    monkeypatch.setattr(parity, "PASSAGES", frequent)
    monkeypatch.setattr(parity, "GATHERED", 50)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for g in range(14):  # chains of copies, each edited a little more, on a common passage, over the edges of bands
        words = ["common"] * 3 + [f"c{k}" for k in range(25)] + [f"g{g}x{k * k % 211}" for k in range(12 * g + 9 * (g % 3))]
        rows += [(100 * (g + 1) + k, edited(words, *range(20, 20 + 3 * k))) for k in range(9)]
        rows += [(100 * (g + 1) + 50 + k, edited(words, 15 + 7 * k)) for k in range(7)]
        rows += [(100 * (g + 1) + 70 + k, " ".join(words[: len(words) - 2 * k])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs) == brute(rows)
    assert found(empty) == []


def test_short_texts(spark):
    """Sets of one to twelve shingles, where single shingles decide."""
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice("ab") for _ in range(draw.randrange(17)))) for k in range(250)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute(rows)


def test_texts_of_common_passages(spark, monkeypatch):
    monkeypatch.setattr(parity, "PASSAGES", 20)
    passages = [[f"p{p}w{k}" for k in range(40)] for p in range(6)]
    rows = []
    for d in range(80):
        words = [w for p in range(6) if d >> p & 1 for w in passages[p]]
        rows.append((d, " ".join([*words, *(f"d{d}x{k}" for k in range(d % 11))])))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute(rows)


def test_copies_of_one_text_and_a_common_passage(spark, monkeypatch):
    """Copies that are each like the original but not like each other, and texts that share a passage and nothing else."""
    monkeypatch.setattr(parity, "COMMON", 3)
    monkeypatch.setattr(parity, "PASSAGES", 0)
    draw = random.Random(8)
    words = [f"o{k}" for k in range(200)]
    rows = [(1000, " ".join(words))] + [(k, edited(words, *draw.sample(range(5, 195), 4))) for k in range(60)]
    rows += [(2000 + k, " ".join([*(f"p{j}" for j in range(60)), *(f"d{k}x{j}" for j in range(20 + 5 * (k % 30)))])) for k in range(60)]
    rows += [(3000 + k, edited(rows[70 + k][1].split(), 70 + k % 3)) for k in range(10)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute(rows)


def test_documents(spark):
    """All pairs of the table, on sets of words instead of hashes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op11_parity(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows)


def test_similar_sets_share_a_signature():
    """For sets at the limit, of any size, with any number of frequent shingles; few segments too, where digests are lacking."""
    draw = np.random.default_rng(5)
    for size in [*range(1, 60), 127, 128, 129, 255, 300, 640, 1023, 1024]:
        for _ in range(6):
            n = draw.integers(size, 5 * size // 4, endpoint=True)
            common = -(-4 * (size + n) // 9)
            if common > size:
                continue
            pool = np.unique(draw.integers(0, 2**64, size + n, np.uint64, endpoint=False))
            a, b = np.sort(pool[:size]), np.sort(np.append(pool[:common], pool[size : size + n - common]))
            assert parity.apart(len(a), len(b)) >= len(a) + len(b) - 2 * common
            hot = pool[draw.random(len(pool)) < draw.choice([0, 0.5, 1])]
            (mine, spare), (theirs, other) = (parity.signatures(x, ~np.isin(x, hot)) for x in (a, b))
            assert len(np.intersect1d(mine, theirs)) > max(spare, other, 0)


def test_sets_without_enough_digests_meet_at_empty_segments(monkeypatch):
    monkeypatch.setattr(parity, "segments", lambda k: 2 ** (k + 1) // 4 + 1)
    draw = np.random.default_rng(6)
    for _ in range(300):
        pool = draw.integers(0, 2**64, 40, np.uint64, endpoint=False)
        a, b = np.sort(pool[:9]), np.sort(pool[1:9])
        assert len(np.intersect1d(parity.signatures(a, a > 0)[0], parity.signatures(b, b > 0)[0]))


def test_sketch_bounds_the_difference():
    draw = np.random.default_rng(7)
    for _ in range(50):
        pool = draw.integers(0, 2**64, 900, np.uint64, endpoint=False)
        a, b = pool[:600], pool[draw.integers(0, 500) :]
        distance = sum(int(x).bit_count() for x in parity.parities(a).view(np.uint64) ^ parity.parities(b).view(np.uint64))
        assert distance <= len(np.setxor1d(a, b))

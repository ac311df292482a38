import re

import pytest

import corpus_pipeline
from docdelta.llm import overlap, simhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def brute_groups(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(words, *places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_stage_drops_copies_with_edits(spark):
    """0.82 of the five-word shingles in common, far more than two bits of the fingerprints apart."""
    words = [f"w{k * 7919 % 1009}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, edited(words, 20, 80, 120, 170)), (3, edited(words, *range(5, 200, 20)))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.first_copies(spark, docs, "").collect()} == {1, 3}


@pytest.mark.parametrize("frequent", [overlap.FREQUENT, 0])
def test_groups_against_brute_force(spark, odd, empty, monkeypatch, frequent):
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for g in range(12):  # chains of copies, each edited a little more, on a common passage
        words = ["common"] * 3 + [f"c{k}" for k in range(25)] + [f"g{g}x{k * k % 211}" for k in range(60 + 9 * g)]
        rows += [(100 * (g + 1) + k, edited(words, *range(30, 30 + 3 * k))) for k in range(9)]
        rows += [(100 * (g + 1) + 50 + k, edited(words, 35 + 7 * k)) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((tuple(r) for r in overlap.similar(docs).collect()), key=str) == brute_groups(rows)
    assert overlap.similar(empty).count() == 0


def test_groups_of_documents(spark):
    """All pairs of the small table, on sets of words instead of hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in overlap.similar(docs).collect()), key=str) == wanted


def test_texts_of_common_passages(spark, monkeypatch):
    """Texts that are four fifths or more of passages that all have, some similar, most not."""
    monkeypatch.setattr(overlap, "FREQUENT", 20)
    passages = [[f"p{p}w{k}" for k in range(40)] for p in range(6)]
    rows = []
    for d in range(80):
        words = [w for p in range(6) if d >> p & 1 for w in passages[p]]
        rows.append((d, " ".join([*words, *(f"d{d}x{k}" for k in range(d % 11))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((tuple(r) for r in overlap.similar(docs).collect()), key=str) == brute_groups(rows)

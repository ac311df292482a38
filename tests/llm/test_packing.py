import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docdelta.llm.packing import Bins, _Offers, _pairs, pack_documents, plan_bins

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("histogram", [{}, {1500: 1000, 600: 7, 700: 900, 900: 30, 1100: 500, 850: 444}, {1: 5000, 2047: 40, 1024: 3}, {2048: 3}, {700: 3000, 690: 1500, 650: 100}])
def test_plan_keeps_every_piece(histogram):
    got = Counter()
    for contents, bins in plan_bins(histogram, 2048):
        assert sum(contents) <= 2048
        for x in contents:
            got[x] += bins
    assert got == Counter(histogram)


def test_search_empties_a_bin():
    """Moves and exchanges find what first fit misses: 6+4, 5+3+2 from a bad start."""
    bins = Bins(10)
    bins.count = Counter({(6, 2): 1, (5, 3): 1, (4,): 1})
    assert bins.search() > 0
    assert sum(bins.count.values()) == 2


def improvements(bins):
    """All moves and exchanges between two underfull bins that raise the sum of squared fills, by brute force."""
    cap, loose = bins.capacity, [c for c, n in bins.count.items() for _ in range(min(n, 2)) if sum(c) < bins.capacity]
    for i, j in itertools.permutations(range(len(loose)), 2):
        a, b = loose[i], loose[j]
        for k, m in ((1, 0), (1, 1), (2, 1), (1, 2)):
            for give, back in itertools.product(itertools.combinations(a, k), itertools.combinations(b, m)):
                x, y = sum(a) - sum(give) + sum(back), sum(b) + sum(give) - sum(back)
                if max(x, y) <= cap and x * x + y * y > sum(a) ** 2 + sum(b) ** 2:
                    yield a, b, give, back


@pytest.mark.parametrize("seed", range(6))
def test_search_ends_where_nothing_improves(seed):
    """No cap stops it: what is left is as few bins as the ids need, or no exchange of two bins helps."""
    rng = np.random.default_rng(seed)
    histogram = Counter(rng.integers(20 + 5 * seed, 75, 60).tolist())
    bins = Bins(100)
    bins.best_fit(dict(histogram))
    before = sum(bins.count.values())
    emptied = bins.search()
    after, least = sum(bins.count.values()), -(-sum(k * n for k, n in histogram.items()) // 100)
    assert before - after == emptied == bins.changes["emptied"]
    assert after == least or next(improvements(bins), None) is None


def test_search_on_many_classes():
    """Where best fit leaves over 400 bins too many and a search of 10,000 changes stopped half-way."""
    histogram = Counter(np.random.default_rng(1).integers(300, 1501, 200_000).tolist())
    bins = Bins(2048)
    bins.best_fit(dict(histogram))
    before = sum(bins.count.values())
    assert bins.search() > 300 and sum(bins.changes.values()) > 10_000
    got = Counter()
    for contents, n in bins.count.items():
        assert sum(contents) <= 2048
        for x in contents:
            got[x] += n
    assert got == histogram and sum(bins.count.values()) < before - 300


def test_bins_of_many_pieces_are_paired():
    """Two pieces of a bin of 66, together 6, fill a bin that has room for one more than it gives back."""
    bins = Bins(200)
    bins.count = Counter({(102, 92, 5): 1, (3,) * 66: 1, (7, 7): 1})
    assert _pairs((4,) * 33 + (2,) * 33) == {(4, 4), (2, 4), (2, 2)}
    bins.ones, bins.twos = _Offers(), _Offers()
    for c in bins.count:
        bins._offer(c, _Offers.add)
    assert bins._better((102, 92, 5)) == (1, (3,) * 66, (3, 3), (5,))


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "some words here", "x", 1), ("a", None, "y", 2), (None, "more", "z", 3)], "doc_id string, text string, length string, piece int")
    rows = pack_documents(docs, PATH).collect()
    assert sorted((r.doc_id or "", r.piece) for r in rows) == [("", 0), ("a", 0), ("b", 0)]
    assert len({r.sequence_id for r in rows}) == 1


def test_rows(spark, odd, empty):
    library = Tokenizer.from_file(PATH)
    capacity = 64
    rows = pack_documents(odd, PATH, capacity=capacity).collect()
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd.collect()}
    places: dict[int, list[tuple[int, int]]] = {}
    whole = Counter()
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length <= capacity and (r.piece == 0 or r.length == capacity)
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole[r.doc_id] += r.length
    for spots in places.values():
        upto = 0
        for offset, length in sorted(spots):
            assert offset == upto
            upto += length
        assert upto <= capacity
    assert whole == Counter({**{k: len(v) for k, v in ids.items()}, 2: 2 * len(ids[2])})
    least = -(-sum(whole.values()) // capacity)
    assert len(places) <= least + 2
    assert pack_documents(empty, PATH).count() == 0


def test_large_counts_are_planned_by_a_factor():
    """The gain of the search does not shrink, nor its time grow, with the pieces; every piece has its place."""
    few = {k: 30 for k in range(500, 900, 2)}
    many = {k: n * 5000 + k % 7 for k, n in few.items()}
    gain = []
    for counts in (few, many):
        fitted = Bins(2048)
        fitted.best_fit(counts)
        planned = plan_bins(counts, 2048)
        placed = Counter()
        for contents, bins in planned:
            assert 0 < sum(contents) <= 2048
            for length in contents:
                placed[length] += bins
        assert placed == Counter(counts)
        gain.append(1 - sum(n for _, n in planned) / sum(fitted.count.values()))
    assert gain[0] > 0.04 and gain[1] > 0.9 * gain[0]

"""Operator 11: documents whose sets of five-word shingles are alike, joined by parity sketches.

A set's shingles fall into segments by their hash, and a segment's digest is the XOR of the hashes in it. Each shingle
that only one of two sets has changes one digest, so sets that differ by at most d shingles (0.8 of Jaccard similarity
bounds d by their sizes) have the digests in common of all but d segments. Sets are compared in bands of sizes, in which
the number of segments is the same. Of its digests, in one order for all sets, each gives its first d + k: two sets
within d have k of these in common. So one with fewer than k digests that many sets have (a common passage's) meets all
that are like it at others, and need not be held against all that share the passage. Pairs that meet are tested on a
sketch of parities, whose Hamming distance is a lower bound of the symmetric difference, and then on their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .names import column
from .overlap import _enough, _filter, _key, _often, _passes, _verified, shingle_set
from .simhash import named
from .skew import join_hot
from .storage import discard, materialise

#: 64-bit words of the sketch that pairs are tested on.
LANES = 16
#: Segments of a band: a share of its largest size, more than the quarter that two similar sets can differ by, and never
#: so few that a small set's shingles crowd in one.
SEGMENTS_SHARE, LEAST_SEGMENTS = 0.36, 64
#: A digest of more sets is a common one. A set gives so many more digests than one in common needs, as a share of d.
COMMON, MORE = 16, 6
#: Rows whose shingles are counted to know those of passages, and how many of these are kept. Neither changes the result.
SAMPLE_ROWS, PASSAGES = 20_000, 400_000
#: Digests that a task holds before it passes them on.
GATHERED = 1_000_000
#: Fixed values of a known mixing function.
_STEP, _MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PARITIES = [f"b{k}" for k in range(LANES)]


def apart(m: int, n: int) -> int:
    """By how many shingles similar sets of m and n members can differ at most: (m + n) (1 - s) / (1 + s) for s = 0.8."""
    return (m + n) // 9


def in_common(n: int) -> int:
    """k: how many of the digests given two similar sets have in common, if the smaller one has n members."""
    return 1 + apart(n, 5 * n // 4) // MORE


def bands(n: int) -> list[tuple[int, int]]:
    """(band, d) in which a set of n members meets others: its own, and the one below if similar sets lie there; d is by
    how many shingles it can differ from those it meets there. Band k holds the sizes from 2^k."""
    k = n.bit_length() - 1
    out = [(k, apart(n, 5 * n // 4))]
    if 4 * n <= 5 * (2**k - 1):
        out.append((k - 1, apart(n, 2**k - 1)))
    return out


def segments(k: int) -> int:
    """The number of segments in a band."""
    return max(LEAST_SEGMENTS, int(SEGMENTS_SHARE * 2 ** (k + 1)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def signatures(h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, int]:
    """(signatures, how many of them may be common ones) of a set of hashes, of which some are ``rare``: in each band the
    first d + k digests, those with rare shingles and with many shingles first, as few sets have these. That order depends
    on a segment's shingles alone.

    A set with fewer digests gives them all. With no more than d it gives its empty segments too, where it meets others
    of the kind; none of its digests may then be left out (-1). Otherwise so many may that a set four fifths its size
    would still have one more in common with it.
    """
    out, more, spare = [], in_common(len(h)), in_common(-(-4 * len(h) // 5)) - 1
    for k, d in bands(len(h)):
        many, start = segments(k), np.uint64((k + 1) * _STEP % 2**64)
        seg = h % np.uint64(many)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        count = np.diff(np.append(first, len(h)))
        digest = _mixed(np.bitwise_xor.reduceat(h[order], first) + start * (seg[first] + np.uint64(1)))
        has_rare = np.add.reduceat(rare[order].astype(np.int64), first) > 0
        chosen = np.lexsort((digest, -count, ~has_rare))[: d + more]
        out.append(digest[chosen])
        if len(first) < d + more:
            spare = -1
        if len(first) <= d:
            out.append(_mixed(start * (np.setdiff1d(np.arange(many, dtype=np.uint64), seg[first]) + np.uint64(1))))
    return np.concatenate(out), spare


def parities(h: np.ndarray) -> np.ndarray:
    """The sketch: for each of 64 LANES bits, whether an odd number of shingles fall on it."""
    bits = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _passages(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least two different texts of a sample have, sorted, with the quarter octaves of how many have
    them, as :func:`docdelta.llm.overlap._often` takes them."""
    one_in = max(texts.count() // SAMPLE_ROWS, 1)
    some = texts.where(F.pmod("th", F.lit(one_in)) == 0).select("th", "text").dropDuplicates(["th"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["h"])

    counted = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(PASSAGES).toArrow()
    h, n = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy().astype(np.float64)
    order = np.argsort(h)
    return h[order], np.minimum(4 * np.log2(n), 127).astype(np.int8)[order]


def _described(texts: DataFrame, shared) -> DataFrame:
    """(doc_id, th, key, n, spare, parities, signatures) of every row; a task gives a set's signatures once, so that copies
    are no load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                keys, sizes, spares, bits, found = [], [], [], [], []
                for text in some.column(2).to_pylist():
                    h = shingle_set(text)
                    key = _key(h)
                    keys.append(key)
                    sizes.append(len(h))
                    bits.append(parities(h))
                    new = len(h) and key not in seen
                    some_signatures, spare = signatures(h, _often(h, frequent) == 0) if new else (h[:0], -1)
                    found.append(some_signatures)
                    spares.append(spare)
                    seen.add(key)
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))
                lanes = np.stack(bits)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(spares, pa.int64()), *(pa.array(lanes[:, k]) for k in range(LANES)), lists],
                    names=["doc_id", "th", "key", "n", "spare", *_PARITIES, "signatures"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th bigint, key bigint, n bigint, spare bigint, {', '.join(f'{b} bigint' for b in _PARITIES)}, signatures array<bigint>")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, signatures) → (s, key, low, alone): each set at each of its signatures. Of the sets that a task has at one, the
    first stands for the others, which have its key in low; its own is null."""
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def passed_on() -> Iterator[pa.RecordBatch]:
        key, s = np.concatenate(keys), np.concatenate(values)
        order = np.lexsort((key, s))
        key, s = key[order], s[order]
        new = np.append(True, (s[1:] != s[:-1]) | (key[1:] != key[:-1]))  # a set may come twice
        key, s = key[new], s[new]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(first, len(s)))
        low = np.repeat(key[first], count)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(key), pa.array(low, mask=low == key), pa.array(np.repeat(count == 1, count))], names=["s", "key", "low", "alone"])

    held = 0
    for batch in batches:
        lists = batch.column(1)
        values.append(lists.flatten().to_numpy())
        keys.append(np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()))
        held += len(values[-1])
        if held > GATHERED:
            yield from passed_on()
            keys.clear()
            values.clear()
            held = 0
    if held:
        yield from passed_on()


def _sets(texts: DataFrame, passing) -> DataFrame:
    """(key, size, shingles) of the rows that pass the filter, read where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = passing.value
        for batch in batches:
            rows = np.flatnonzero(_passes(batch.column(0).to_numpy(), words))
            for text in batch.column(1).take(pa.array(rows)).to_pylist():
                h = shingle_set(text)
                yield pa.RecordBatch.from_arrays([pa.array([_key(h)], pa.uint64()).view(pa.int64()), pa.array([len(h)], pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["key", "size", "shingles"])

    return texts.select(F.xxhash64("doc_id", "th"), "text").mapInArrow(run, "key bigint, size bigint, shingles array<bigint>")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and sketches allow their similarity."""
    side = lambda key, mark: sets.select(F.col("key").alias(key), F.col("size").alias(f"n_{mark}"), *(F.col(b).alias(f"{b}_{mark}") for b in _PARITIES))
    both = pairs.join(side("u", "u"), "u").join(side("v", "v"), "v")
    distance = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{b}_u").bitwiseXOR(F.col(f"{b}_v"))) for b in _PARITIES))
    return both.where(_sized(F.col("n_u"), F.col("n_v"))).where(9 * distance <= F.col("n_u") + F.col("n_v")).select("u", "v")


def _sized(m: Column, n: Column) -> Column:
    return _enough(m, n, F.least(m, n))


def _groups(first: DataFrame, texts: DataFrame, met: DataFrame, write) -> DataFrame:
    """(node, root) of the keys that are linked. Every set is first held against one other, which joins most copies; then
    any two that meet and are not of one group are."""
    spark = first.sparkSession

    def verified(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
        if known is not None:
            wanted = wanted.join(known.select("key"), "key", "left_anti")
        rows = write(wanted.join(first.select("key", F.xxhash64("row.doc_id", "row.th").alias("row")), "key"), "wanted")
        found = write(_sets(texts, spark.sparkContext.broadcast(_filter(rows, rows.count()))), "sets")  # a filter of at most 16 MB
        found = found if known is None else known.unionByName(found)
        return write(_verified(pairs, found), "links"), found

    # The centre at a signature: the set with the fewest signatures of its own, such as the one that others are copies of.
    # A set is held against the centre that it meets most often.
    own = met.groupBy("key").agg(F.count("*").alias("shared")).join(first.select("key", "given"), "key").select("key", (F.col("given") - F.col("shared")).alias("own"))
    by = met.join(own, "key").groupBy("s").agg(F.min(F.struct("own", "key")).alias("c"), F.count("*").alias("sets")).select("s", F.col("c.key").alias("centre"), (F.col("sets") > COMMON).alias("common"))
    placed = write(met.join(by, "s"), "placed")
    often = placed.where("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("centre", F.struct("n", "centre")).alias("v"))
    tested = write(_close(often.select(F.col("key").alias("u"), "v"), first), "pairs")
    edges, sets = verified(tested, None)
    grouped = write(components(edges), "roots").select(F.col("node").alias("key"), "root")
    # A set with no more common signatures than it can spare meets all that are like it at others.
    heavy = placed.groupBy("key").agg(F.count_if("common").alias("n")).join(first.select("key", "spare"), "key").where("n > spare").select("key")
    open_ = placed.where("not common").select("s", "key").unionByName(placed.where("common").select("s", "key").join(heavy, "key", "left_semi"))
    now = open_.join(grouped, "key", "left").select("s", "key", F.coalesce("root", "key").alias("group"))
    # Only signatures where several groups meet; the members of the largest one there are not held against each other.
    sizes = now.groupBy("s", "group").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("s").agg(F.max_by("group", F.struct("c", "group")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("s", "largest")
    half = LANES // 2  # a sketch folded in two is one of half the bits
    folded = first.select("key", "size", *(F.col(a).bitwiseXOR(F.col(b)).alias(a) for a, b in zip(_PARITIES[:half], _PARITIES[half:])))
    left = write(now.join(largest, "s").select("s", "key", "group", F.expr("group = largest").alias("big")).join(folded, "key"), "left")
    others = left.where("not big").select("s", F.col("key").alias("v"), F.col("group").alias("g"), F.col("size").alias("n"), *(F.col(b).alias(f"{b}_v") for b in _PARITIES[:half]))
    apart_ = reduce(lambda x, y: x + y, (F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_v"))) for b in _PARITIES[:half]))
    alike = left.join(others, "s").where("group <> g and (big or key > v)").where(_sized(F.col("size"), F.col("n")) & (9 * apart_ <= F.col("size") + F.col("n")))
    pairs = alike.select(F.col("key").alias("u"), F.col("v")).distinct()
    same = tested.unionByName(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
    more = write(_close(pairs.join(same, ["u", "v"], "left_anti"), first), "pairs")
    found, _ = verified(more, sets)
    return write(components(edges.unionByName(found)), "roots")


def join_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every input row.

    A text's set holds its different five-word shingles (A-Z in lower case; fewer words are one shingle), as 64-bit
    hashes. Texts link when the Jaccard similarity of their sets is at least 0.8; ``component_id`` is the smallest id
    reachable over links, the row's own included. Null, empty and wordless texts have no shingles and link with nothing.
    Null ids keep their row, link, and never name a component; repeated rows share one; an empty table gives no rows.
    Whole texts count; other columns, whatever their names, are left out.

    Equal sets are one from the start. About a third as many signatures as shingles move, those of frequent shingles
    last; sets move only if their sketches are close enough to another's. The frequent shingles come from a sample of
    texts, which changes the work, not the result.
    """
    paths: list[str] = []

    def write(table: DataFrame, name: str) -> DataFrame:
        out, path = materialise(table, name)
        paths.append(path)
        return out

    text = column(text_col).cast("string")
    texts = docs.select(column(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_passages(texts))  # at most PASSAGES shingles
    rows = write(_described(texts, shared), "rows")
    first = write(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "th")).alias("row"), F.min("n").alias("size"), F.max("spare").alias("spare"), F.max(F.size("signatures")).alias("given"), F.count("*").alias("n"), *(F.min(b).alias(b) for b in _PARITIES)), "distinct")
    at = Window.partitionBy("s", F.when(F.col("low").isNotNull(), F.col("key")))  # those that stand for others meet; the rest are dealt out
    gathered = rows.where(F.size("signatures") > 0).select("key", "signatures").mapInArrow(_gathered, "s bigint, key bigint, low bigint, alone boolean")
    placed = gathered.withColumns({"least": F.min("key").over(at), "most": F.max("key").over(at)})
    met = write(placed.where("not alone or least < most").select("s", "key").distinct(), "met")  # tasks have copies in common
    label = write(named(first.select("key", "first", "n"), "key", _groups(first, texts, met, write)), "labels")
    linked = join_hot(rows.where("n > 0").select("doc_id", "key", F.col("n").alias("n_shingles")), label, "key", first.agg(F.sum("n")).first()[0] or 0)
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out, _ = materialise(linked.select("doc_id", "n_shingles", "component_id").unionByName(alone), "similar")
    for path in paths:
        discard(docs.sparkSession, path)
    return out

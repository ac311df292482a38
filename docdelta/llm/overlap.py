"""Near-duplicates by the Jaccard similarity of their word shingles, exactly.

Texts of similarity s have at least s n shingles in common, n being the size of either set. So a text is of interest
only if that many of its shingles occur in other texts, which two rounds find out: first on a part of each set (all
shingles have one order; if two sets have o shingles in common, their first n - o + k have at least k), then on whole
sets of the texts that are left. These are first compared with those that SimHash proposes and with two texts at each
of their first shingles, rare ones first, which joins most copies. Then any two that meet at such a shingle are compared
if they are not yet of one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .names import column
from .simhash import SEED, shingle_hashes
from .skew import dealt, join_hot
from .storage import discard, materialise, release_shuffles

WORDS, SIMILAR = 5, (4, 5)
#: Rows whose shingles are counted to know the most frequent ones, and how many of these are kept. Neither changes the
#: result, only the amount of work.
SAMPLE_ROWS, FREQUENT = 5_000, 200_000
#: A text's part of the first round holds so many more shingles than one in common needs, as a share of its set.
MORE = 20
#: Sets are described by how many of their shingles fall into each of these classes of hashes, up to 127: where the counts
#: differ, so do the sets.
SEGMENTS = 32
#: The largest filter of texts, as a power of two of bits (16 MB). Beyond it more texts pass, and only work is lost.
FILTER_BITS = 27
#: A shared shingle is written as how many sets it is in, in steps of a quarter octave, above the other bits of its hash.
#: Two similar sets are at most SIZES_APART classes of sizes apart, when a class reaches from n to n / 0.8.
COUNT_BITS, SIZES_APART = 7, 1


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    return _set(list(shingle_hashes(text, WORDS)))


def _set(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _key(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def least_common(n):
    """What a set of n members has in common with a similar one, at least."""
    num, den = SIMILAR
    return -(-num * n // den)


def _more(n):
    return np.maximum(n // MORE, 1)


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least two rows of a sample have, sorted, with the quarter octaves of how many sets have them."""
    one_in = max(texts.count() // SAMPLE_ROWS, 1)
    some = texts.where(F.pmod("th", F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["h"])

    counted = some.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy().astype(np.float64)
    order = np.argsort(h)
    return h[order], np.minimum(4 * np.log2(n * one_in), 2**COUNT_BITS - 1).astype(np.int8)[order]


def _often(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The quarter octaves of the frequent shingles, 0 for others."""
    some, count = frequent
    if not len(some):
        return np.zeros(len(h), np.int8)
    at = np.minimum(np.searchsorted(some, h), len(some) - 1)
    return np.where(some[at] == h, count[at], 0).astype(np.int8)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def _first_round(texts: DataFrame, shared) -> DataFrame:
    """(doc_id, th, key, n, fp, often, seg, part) of every row: key stands for the set of shingles, n for its size, fp is
    the SimHash, seg counts the shingles in each segment; part: the set's first shingles but for the frequent ones,
    which come last and are counted in often. A task gives the part of a set once, so that copies are no load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                keys, sizes, fps, often, segs, parts = [], [], [], [], [], []
                for text in some.column(2).to_pylist():
                    found = list(shingle_hashes(text, WORDS))
                    h = _set(found)
                    key, n = _key(h), len(h)
                    keys.append(key)
                    sizes.append(n)
                    fps.append(simhash.simhash(found))
                    hot = _often(h, frequent) > 0
                    length = n - least_common(n) + _more(n) if n else 0
                    rare = h[~hot][:length]
                    often.append(length - len(rare))
                    segs.append(np.minimum(np.bincount((h % SEGMENTS).astype(np.int64), minlength=SEGMENTS), 127).astype(np.int8))
                    parts.append(rare if key not in seen else h[:0])
                    seen.add(key)
                arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, sizes, fps, often)]
                seg = pa.ListArray.from_arrays(pa.array(np.arange(0, SEGMENTS * len(segs) + 1, SEGMENTS, np.int32)), pa.array(np.concatenate(segs)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *arrays, seg, _lists(parts)], names=["doc_id", "th", "key", "n", "fp", "often", "seg", "part"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th bigint, key bigint, n bigint, fp bigint, often bigint, seg array<tinyint>, part array<bigint>")


def _filter(left: DataFrame, count: int) -> np.ndarray:
    """Bits of a filter of the rows that are left, some sixteen for each of ``count``, at most FILTER_BITS: it passes them
    all, and few others unless there are very many. Its words are put together before the driver gets them."""
    bits = 1 << min(max(16 * count, 64).bit_length(), FILTER_BITS)
    at = F.pmod("row", F.lit(bits))
    words = left.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row, {bits}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def _passes(row: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = row.astype(np.int64).view(np.uint64) & np.uint64(64 * len(words) - 1)
    return words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


def _whole_sets(texts: DataFrame, shared, passing) -> DataFrame:
    """(key, h, often): every shingle of the texts that pass the filter, which knows one row of each set; often: for a
    frequent one its quarter octaves, else 0. Texts are read where they lie; a task gives a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words, seen = shared.value, passing.value, set()
        for batch in batches:
            rows = np.flatnonzero(_passes(batch.column(0).to_numpy(), words))
            for text in batch.column(1).take(pa.array(rows)).to_pylist():
                h = shingle_set(text)
                key = _key(h)
                if key in seen:
                    continue
                seen.add(key)
                keys = np.full(len(h), key, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h.view(np.int64)), pa.array(_often(h, frequent))], names=["key", "h", "often"])

    return texts.select(F.xxhash64("doc_id", "th"), "text").mapInArrow(run, "key bigint, h bigint, often tinyint")


def _need(n: Column) -> Column:
    num, den = SIMILAR
    return F.ceil(F.lit(num) * n / F.lit(den)).cast("bigint")


def _enough(m: Column, n: Column, common: Column) -> Column:
    """Whether sets of m and n members with this many in common have the similarity."""
    num, den = SIMILAR
    return (num + den) * common >= num * (m + n)


def _may_be(m: Column, n: Column, rest: Column, a: Column, b: Column) -> Column:
    """Whether sets of m and n members can be similar, if they have at most ``rest`` in common and these segments: what
    the counts of segments differ by is not in common either."""
    num, den = SIMILAR
    apart = reduce(lambda x, y: x + y, (F.abs(F.get(a, k).cast("int") - F.get(b, k).cast("int")) for k in range(SEGMENTS)))
    return _enough(m, n, rest) & ((num + den) * apart <= (den - num) * (m + n))


def _candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(keys, first, sets, paths): every row's (doc_id, key); each key's smallest id, size, fingerprint and number of rows; the
    shared shingles, rare ones first, of the keys of which enough are; the tables to delete in the end."""
    paths: list[str] = []
    write = lambda table, name: _write(table, name, paths)
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts))  # at most FREQUENT shingles
    rows, parts = materialise(_first_round(texts, shared), "parts")
    first = write(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "th")).alias("row"), F.min("n").alias("size"), F.min("fp").alias("fp"), F.min("often").alias("often"), F.min("seg").alias("seg"), F.count("*").alias("n")), "distinct")
    at = Window.partitionBy("h")
    postings = rows.select("key", F.explode("part").alias("h")).withColumns({"low": F.min("key").over(at), "high": F.max("key").over(at)}).where("low < high")
    known = postings.groupBy("key").agg(F.count("*").alias("c"))
    least = F.greatest(F.floor(_need(F.col("size")) / MORE), F.lit(1))
    left = write(first.join(dealt(known), "key", "left").where(F.coalesce("c", F.lit(0)) + F.col("often") >= least).where("size > 0").select("key", F.xxhash64("row.doc_id", "row.th").alias("row"), "size", "seg"), "left")
    keys = write(rows.select("doc_id", "key"), "keys")
    discard(texts.sparkSession, parts)  # the largest of the tables, and done with
    release_shuffles(texts.sparkSession)
    passing = texts.sparkSession.sparkContext.broadcast(_filter(left, left.count()))  # at most 2^FILTER_BITS bits
    salted = Window.partitionBy("h", F.when(F.col("often") > 0, F.col("key")))
    count = F.when(F.col("often") > 0, F.col("often").cast("bigint")).otherwise(F.least(4 * F.log2(F.count("*").over(salted)), F.lit(2**COUNT_BITS - 1)).cast("bigint"))
    counted = _whole_sets(texts, shared, passing).withColumn("df", count).where("df > 0")
    shingle = F.shiftleft("df", 64 - 1 - COUNT_BITS).bitwiseOR(F.shiftrightunsigned("h", COUNT_BITS + 1))
    sets = counted.select("key", shingle.alias("s")).groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("shingles"))
    enough = sets.join(dealt(left.select("key", "size", "seg")), "key").where(F.size("shingles") >= _need(F.col("size")))
    return keys, first, write(enough.select("key", "size", "seg", "shingles"), "sets"), paths


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar; all that they have in common is among the shared shingles."""
    wanted = lambda key: sets.join(dealt(pairs.select(F.col(key).alias("key"))), "key", "left_semi")
    side = lambda key, s, n: wanted(key).select(F.col("key").alias(key), F.col("shingles").alias(s), F.col("size").alias(n))
    both = pairs.join(dealt(side("u", "a", "m")), "u").join(dealt(side("v", "b", "k")), "v")
    return both.where(_enough(F.col("m"), F.col("k"), F.size(F.array_intersect("a", "b")))).select("u", "v")


def _by_fingerprint(sets: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs (u, v) that SimHash proposes: each key with the smallest of its fingerprint, and these along the links."""
    known = sets.select("key").join(dealt(first.select("key", "fp")), "key")
    head = known.groupBy("fp").agg(F.min("key").alias("head"))
    same = known.join(dealt(head), "fp").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    near = simhash.links(head.select("fp"))
    of = lambda fp, key: dealt(head.select(F.col("fp").alias(fp), F.col("head").alias(key)))
    return same.unionByName(near.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v")))


def _write(table: DataFrame, name: str, paths: list[str]) -> DataFrame:
    out, path = materialise(table, name)
    paths.append(path)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every input row.

    Texts link when the Jaccard similarity of their five-word shingles is at least 0.8 (sets of 64-bit hashes; A-Z in
    lower case; fewer words are one shingle); ``component_id`` is the smallest id reachable over links. Null and
    wordless texts are alike. Null ids link but never name a component; repeated rows share one; an empty table gives
    no rows. Whole texts count, and other columns, whatever their names, are left out.

    Shuffled are about a quarter of all shingles and then those of the texts of which enough occur elsewhere. Two texts
    that meet at a shingle are compared only if it and all that follow it in both sets would do, and if the counts of
    their segments, whose Manhattan distance is a lower bound of what they do not have in common, allow it.
    """
    text = column(text_col).cast("string")
    texts = docs.select(column(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys, first, sets, paths = _candidates(texts)
    release_shuffles(docs.sparkSession)
    num, den = SIMILAR
    skipped = F.col("size") - F.size("shingles")  # shingles of no other text come first
    places = F.slice("shingles", F.lit(1), (F.col("size") - _need(F.col("size")) + 1 - skipped).cast("int"))
    hits = _write(sets.select("key", "size", F.size("shingles").alias("k"), F.posexplode(places).alias("pos", "h")).select("key", "size", "h", (F.col("k") - F.col("pos")).alias("rest"), (F.col("size") - F.col("k")).alias("own")), "hits", paths)
    index = F.lit(num + den) * F.col("rest") >= F.lit(2 * num) * F.col("size")  # where the smaller of two similar sets has their first in common
    # Centres: the text with the fewest shingles of its own, such as the one that others are edited copies of; any other.
    fields = (F.col("key").alias("other"), F.col("size").alias("m"), F.col("rest").alias("r"))
    fewest, drawn = (F.struct(x.cast("bigint").alias("x"), F.xxhash64("key").alias("y"), *fields) for x in (F.col("own"), F.lit(0)))
    centres = hits.groupBy("h").agg(F.array(F.min(fewest), F.max(drawn)).alias("c")).select("h", F.inline("c")).drop("x", "y")
    star = hits.join(dealt(centres), "h").where(_enough(F.col("size"), F.col("m"), F.least("rest", "r")))
    tested = _write(_ordered(_by_fingerprint(sets, first).unionByName(star.select(F.col("key").alias("u"), F.col("other").alias("v")))), "pairs", paths)
    edges = _write(_verified(tested, sets), "links", paths)
    groups = _write(components(edges), "roots", paths)
    release_shuffles(docs.sparkSession)
    now = hits.select("key", "h", "rest").join(dealt(groups.select(F.col("node").alias("key"), "root")), "key", "left").select("key", "h", "rest", F.coalesce("root", "key").alias("group"))
    # Only shingles where several groups meet; the members of the largest one there are not held against each other.
    sizes = now.groupBy("h", "group").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("h").agg(F.max_by("group", F.struct("n", "group")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("h", "largest")
    described = sets.select("key", "size", "seg")
    open_ = _write(now.join(dealt(largest), "h").withColumn("big", F.expr("group = largest")).drop("largest").join(dealt(described), "key"), "open", paths)
    sized = F.floor(F.log(F.col("size")) / F.lit(math.log(den / num)) + F.lit(1e-9)).cast("int")
    larger = open_.select("h", sized.alias("class"), F.col("key").alias("other"), F.col("size").alias("m"), F.col("group").alias("g"), F.col("rest").alias("r"), F.col("seg").alias("b"), F.col("big").alias("bg"))
    smaller = open_.where(index).withColumn("class", F.explode(F.sequence(sized, sized + SIZES_APART)))
    alike = F.expr("group <> g and size <= m") & _may_be(F.col("size"), F.col("m"), F.least("rest", "r"), F.col("seg"), F.col("b"))
    met = smaller.where("not big").join(dealt(larger), ["h", "class"]).where(alike).select("key", "other").unionByName(smaller.where("big").join(dealt(larger.where("not bg")), ["h", "class"]).where(alike).select("key", "other"))
    pairs = met.select(F.col("key").alias("u"), F.col("other").alias("v"))
    pairs = _write(_ordered(pairs).join(dealt(tested), ["u", "v"], "left_anti"), "pairs", paths)
    release_shuffles(docs.sparkSession)
    edges = edges.unionByName(_write(_verified(pairs, sets), "links", paths))
    roots = _write(components(edges), "roots", paths)
    label, _ = materialise(simhash.named(first.select("key", "first", "n"), "key", roots), "labels")
    named, _ = materialise(join_hot(keys, label, "key", first.agg(F.sum("n")).first()[0] or 0).select("doc_id", "component_id"), "components")
    for path in paths:
        discard(docs.sparkSession, path)
    return named

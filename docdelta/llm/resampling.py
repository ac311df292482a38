"""Operator 12: documents drawn by how much they resemble a target corpus, over bucket-partitioned inverted postings.

Word features fall into hashed buckets. Postings (bucket, document, count) of both corpora go to their bucket, which knows
its gain from its own counts; documents get their buckets' contributions back. Postings travel packed, a row for each
bucket and block of documents, so a bucket that every document has is as many rows as any other and can be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column
from .simhash import _slices
from .storage import materialise

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 25, 7
#: A block ends with so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 4_096, 2_000_000
#: A bucket's postings go to so many tasks: a bucket of every document is no single task's.
SLICES = 16
_WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def feature_buckets(text: bytes | None) -> np.ndarray:
    """The bucket of every word and every pair of neighbouring words, repeats included."""
    out, begun = [], False
    for words in _slices((text or b"").translate(_WORDS), 2):
        if not words:
            continue
        one = list(map(crc32, words))
        # crc32 continues from a value: a pair's is the first word's, carried over a space and the second word
        two = list(map(crc32, words[1:], map(crc32, repeat(b" "), one[:-1])))
        out += [np.array(one[begun:], np.uint32), np.array(two, np.uint32)]
        begun = True  # a later slice repeats the last word of the one before
    return (np.concatenate(out) % BUCKETS).astype(np.int64) if out else np.zeros(0, np.int64)


_POSTINGS = "kind string, block bigint, bucket int, n bigint, places binary, counts binary, doc {id}, at int"


def _postings(corpus: DataFrame, id_type: str) -> DataFrame:
    """Rows of two kinds: ``doc`` (block, at, doc, n) has each document's place in its block and number of features;
    ``bucket`` (block, bucket, n, places, counts) has the places of a bucket's documents (unsigned 16 bits) with their
    counts (unsigned 8 bits, or 32 if one needs more), n being their sum. The corpus has the columns doc and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        sizes: list[int] = []
        coded: list[np.ndarray] = []
        counted: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            code, n = np.concatenate(coded), np.concatenate(counted)
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            bucket, place = code >> 16, (code & 0xFFFF).astype(np.uint16)
            rows = len(sizes)
            none = lambda kind, count=rows: pa.nulls(count, kind)
            doc = [pa.array(["doc"] * rows), pa.array([block] * rows, pa.int64()), none(pa.int32()), pa.array(sizes, pa.int64()), none(pa.binary()), none(pa.binary()), pa.concat_arrays(ids), pa.array(np.arange(rows, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(doc, names=["kind", "block", "bucket", "n", "places", "counts", "doc", "at"])
            if not len(code):
                return
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[first[1:], len(code)]
            places = [place[a:b].tobytes() for a, b in zip(first, ends)]
            counts = [n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.uint32).tobytes() for a, b in zip(first, ends)]
            m = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["bucket"] * m), pa.array([block] * m, pa.int64()), pa.array(bucket[first].astype(np.int32)), pa.array(np.add.reduceat(n, first)), pa.array(places, pa.binary()), pa.array(counts, pa.binary()), none(ids[0].type, m), none(pa.int32(), m)],
                names=["kind", "block", "bucket", "n", "places", "counts", "doc", "at"],
            )

        held = 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                found, n = np.unique(feature_buckets(text.as_py()), return_counts=True)
                coded.append(found << 16 | len(sizes))
                counted.append(n)
                ids.append(batch.column(0).slice(k, 1))
                sizes.append(int(n.sum()))
                held += len(found)
                if len(sizes) == BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield from packed()
                    block, held = block + 1, 0
                    for x in (ids, sizes, coded, counted):
                        x.clear()
        if sizes:
            yield from packed()

    return corpus.mapInArrow(run, _POSTINGS.format(id=id_type))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gain, places, counts), sorted by block → (block, sums): what these buckets give each of the block's documents."""
    now, sums, top = None, None, 0

    def told() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sums[: top + 1].tobytes()], pa.binary())], names=["block", "sums"])

    for batch in batches:
        for block, gain, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "gain", "places", "counts"))):
            if block != now:
                yield from told()
                now, sums, top = block, np.zeros(BLOCK_DOCS, np.int64), 0
            at = np.frombuffer(places, np.uint16)
            top = max(top, int(at[-1]))
            sums[at] += gain * np.frombuffer(counts, np.uint8 if len(counts) == len(at) else np.uint32).astype(np.int64)
    yield from told()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sums), a block's rows together → (block, at, total), a row for each place up to the last that has any."""
    now, total = None, np.zeros(0, np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), now)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["block", "at", "total"])

    for batch in batches:
        for block, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "sums"))):
            if block != now:
                yield from told()
                now, total = block, np.zeros(0, np.int64)
            part = np.frombuffer(sums, np.int64)
            if len(part) > len(total):
                total = np.append(total, np.zeros(len(part) - len(total), np.int64))
            total[: len(part)] += part
    yield from told()


def _gain(t: Column, s: Column, target: int, raw: int) -> Column:
    """floor(1000 ln) of how much likelier the bucket is in the target corpus than in the raw one, smoothed by one."""
    return F.floor(1000 * F.log((t + 1) * F.lit(float(raw + BUCKETS)) / ((s + 1) * F.lit(float(target + BUCKETS)))))


def _floor_mean(total: Column, n: Column) -> Column:
    return F.call_function("div", total - F.pmod(total, n), n)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, all long.

    Features are words and pairs of neighbouring words of whole texts (A-Z in lower case; digits, letters and characters
    beyond ASCII make words), hashed into BUCKETS buckets. A document's weight is the floored mean of its features'
    gains, 0 without features; the score adds Gumbel noise that the id's hash decides, so equal ids have equal noise. Of
    the documents with at least LEAST_WORDS words the SHARE % with the highest scores are ranked from 1, ties to the
    smaller id; the others' rank is null.

    Null texts are empty. Null ids share the noise of an empty id and lose ties; repeated rows are documents each, in any
    order among themselves. An empty target gives every bucket a gain from the documents alone; an empty table gives no
    rows; other columns, whatever their names, are left out. Texts are read once; what moves are packed postings
    and, for each task and block, one sum a document.
    """
    spark = docs.sparkSession
    text = lambda table, c: column(c).cast("string").cast("binary").alias("text")
    id_type = docs.schema[id_col].dataType.simpleString()
    raw, _ = materialise(_postings(docs.select(column(id_col).alias("doc"), text(docs, text_col)), id_type), "postings", "kind")
    wanted = _postings(target.select(F.lit(None).cast(id_type).alias("doc"), text(target, target_text_col)), id_type).where("kind = 'bucket'")
    counted = raw.where("kind = 'bucket'").groupBy("bucket").agg(F.sum("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(wanted.groupBy("bucket").agg(F.lit(0).cast("bigint").alias("s"), F.sum("n").alias("t")))
    both, _ = materialise(counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")  # at most BUCKETS rows
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    # Each bucket's postings and counts meet in its partitions, where the gain is computed.
    corpora = both.select("bucket", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    sliced = raw.where("kind = 'bucket'").select("bucket", "block", F.pmod(F.hash("block"), F.lit(SLICES)).alias("slice"), "places", "counts")
    met = sliced.join(corpora.hint("shuffle_hash"), ["bucket", "slice"]).select("block", _gain(F.col("t"), F.col("s"), all_t, all_s).alias("gain"), "places", "counts")
    given = met.sortWithinPartitions("block").mapInArrow(_contributions, "block bigint, sums binary")
    totals = given.repartition("block").sortWithinPartitions("block").mapInArrow(_by_document, "block bigint, at int, total bigint")
    known = raw.where("kind = 'doc'").select("block", "at", "doc", "n").join(totals, ["block", "at"], "left")
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weight = F.when(F.col("n") > 0, _floor_mean(F.coalesce("total", F.lit(0)), F.nullif("n", F.lit(0)))).otherwise(F.lit(0)).cast("bigint")
    scored, _ = materialise(known.withColumn("weight", weight).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_features"), "weight", (F.col("weight") + noise).alias("score")), "scored")
    return _ranked(scored)


def _ranked(scored: DataFrame) -> DataFrame:
    """Scores are whole numbers in a range that the logarithms bound, so their counts are a small table: a document's rank
    is how many score higher and its place among equals, and no task sorts all."""
    may = F.col("n_features") >= 2 * LEAST_WORDS - 1  # n words have 2 n - 1 features
    counts = scored.where(may).groupBy("score").agg(F.count("*").alias("c"))
    above = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = counts.withColumn("above", above).withColumn("drawn", F.call_function("div", F.sum("c").over(Window.partitionBy()) * SHARE, F.lit(100))).where("above < drawn").select("score", "above", "drawn")
    placed = scored.where(may).join(F.broadcast(levels), "score")  # a row for each score that can be drawn
    at = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("above")
    best = placed.withColumn("rank", at.cast("bigint")).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = scored.join(F.broadcast(levels.select("score", F.lit(True).alias("hit"))), "score", "left").where(F.coalesce(~(may & F.col("hit")), F.lit(True)))
    columns = ["doc_id", "n_features", "weight", "score"]
    return best.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("bigint").alias("rank")))

"""Operator 6: near-duplicates by SimHash, found through a grid of per-segment bit counts.

A fingerprint's 64 bits fall into segments (21 of three bits, one of one); the vector of their bit counts differs
between two fingerprints by at most their Hamming distance in Manhattan distance. A range join on the grid of these
vectors proposes pairs, which are verified exactly on the fingerprints.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .names import column, select_named, spare
from .skew import dealt, join_hot
from .storage import materialise

SEED, WORDS = 42, 3
#: Fingerprints in a cell of the grid up to which all its pairs are verified; a fuller cell's meet at shared neighbours.
CROWD = 8
#: Words of a text handled at a time.
SLICE = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LANES = 0o1111111111111111111111  # the lowest bit of each segment
_LANES -= (1 << 64) * (_LANES >> 63)


def _slices(data: bytes, width: int) -> Iterator[list[bytes]]:
    """The words in lists that overlap by ``width`` - 1, so that each shingle lies in exactly one."""
    if len(data) < 8 * SLICE:
        yield data.split()
        return
    found, kept = (m.group() for m in _WORD.finditer(data)), []
    while some := list(itertools.islice(found, SLICE)):
        words = kept + some
        yield words
        kept = words[-(width - 1) :] if width > 1 else []


def shingle_hashes(text: str | None, width: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles of ``width`` words, repeats included; fewer words are one shingle, none are none."""
    data, n = (text or "").encode("utf-8", "surrogatepass").lower(), 0  # A-Z only
    for words in _slices(data, width):
        if not words:
            continue
        if len(words) < width:
            if n:  # the rest of a long text, already part of its last shingles
                continue
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
        n += len(h)
        yield h


def fingerprint(text: str | None) -> int:
    """SimHash of a text's three-word shingles, repeats included, as an unsigned integer."""
    return simhash(shingle_hashes(text))


def simhash(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes; zero without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())) if n else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): every row's fingerprint as a signed 64-bit integer; no shuffle."""
    source = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                found = np.array([fingerprint(t) for t in some.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _cells(fp: Column) -> Column:
    """The grid cell of a fingerprint and all cells at Manhattan distance 1: an array of packed bit counts."""
    lanes = F.lit(_LANES)
    cell = fp.bitwiseAND(lanes) + F.shiftrightunsigned(fp, 1).bitwiseAND(lanes) + F.shiftrightunsigned(fp, 2).bitwiseAND(lanes)
    around = [cell]
    for lane in range(22):
        one = 1 << 3 * lane
        count = F.shiftrightunsigned(cell, 3 * lane).bitwiseAND(F.lit(7))
        if lane == 21:
            around.append(cell.bitwiseXOR(F.lit(-(1 << 63))))
        else:
            around += [F.when(count < 3, cell + F.lit(one)), F.when(count > 0, cell - F.lit(one))]
    return F.array_compact(F.array(*around))


def _hubs(fp: Column) -> Column:
    """The fingerprint and all at Hamming distance 1; two fingerprints share one if and only if they differ in at most 2 bits."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(64)))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges between fingerprints that differ in at most 2 bits, enough of them that their components are
    those of all such pairs. ``distinct`` has a column fp without repeats.

    Two cells at Manhattan distance 2 or less have a cell in common among themselves and those beside them, so each
    fingerprint goes to its own cell and those beside it: two within range meet in one. All pairs of a cell with up to
    CROWD fingerprints are verified. Fingerprints of fuller cells meet at those one bit away instead, where each is
    linked to the smallest: rows are a constant times the fingerprints, never pairs of a group.
    """
    cell = Window.partitionBy("cell")
    on_grid = distinct.select("fp", F.explode(_cells(F.col("fp"))).alias("cell")).withColumn("n", F.count("*").over(cell))
    shared, _ = materialise(on_grid.where("n > 1"), "cells")
    few = shared.where(F.col("n") <= CROWD)
    near = few.select("cell", F.col("fp").alias("u")).join(few.select("cell", F.col("fp").alias("v")).hint("merge"), "cell")
    pairs = near.where("u > v and bit_count(u ^ v) <= 2").select("u", "v")
    at_hub = shared.where(F.col("n") > CROWD).select("fp").distinct().select("fp", F.explode(_hubs(F.col("fp"))).alias("hub"))
    least = at_hub.groupBy("hub").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("hub", "least")
    stars = at_hub.join(dealt(least), "hub").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every input row.

    Fingerprints link at 2 or fewer differing bits; ``component_id`` is the smallest id reachable over links.
    Null and wordless texts have fingerprint zero and link like any other; null ids keep their row and never name a
    component (a component of null ids only has a null one); repeated rows share a component; an empty table gives
    no rows. Whole texts count, in slices of SLICE words; other columns, whatever their names, are left out. Copies
    are grouped by fingerprint before anything is compared, and rows of a fingerprint that very many have are
    labelled where they are.
    """
    found, _ = materialise(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    first, _ = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots, _ = materialise(components(links(first.select("fp"))), "roots")
    label = named(first, "fp", roots)
    total = first.agg(F.sum("n")).first()[0] or 0
    return join_hot(found, label, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(first: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id, n) of all keys in ``first`` (key, first, n): the smallest ``first`` of the key's component."""
    linked = first.join(dealt(roots.withColumnRenamed("node", key)), key)
    names = linked.groupBy("root").agg(F.min("first").alias("component"))
    moved = linked.join(dealt(names), "root").select(key, "component")
    return first.join(dealt(moved), key, "left").select(key, F.coalesce("component", "first").alias("component_id"), "n")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grouped=near_duplicates) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id; repeated rows of an id stay once.

    ``grouped`` gives (doc_id, component_id) of the rows. Rows with a null id name nothing and stay.
    """
    found, _ = materialise(grouped(docs, id_col=id_col, text_col=text_col), "components")
    copies = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n"))
    (mark,) = spare(docs.columns, "later")
    later = copies.where("not first").select(F.col("doc_id").alias(mark))
    kept = select_named(docs.join(later, column(id_col) == F.col(mark), "left_anti"), docs.columns)
    if copies.where("n > 1").isEmpty():
        return kept
    known = column(id_col).isNotNull()
    once = kept.where(known).withColumn(mark, column(id_col)).dropDuplicates([mark])
    return kept.where(~known).unionByName(select_named(once, docs.columns))

"""Operator 13: how the sources of a language differ in their words, from one sorted stream.

Terms are counted for blocks of documents, dealt by language and term and sorted by (term, language, source, block); a
scan of the runs gives document frequencies and counts. Pairs of sources are summed run by run, over the sources that
have the term alone: what absent terms add is known from each source's counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column
from .storage import materialise

#: Documents of its language that a term needs, the scale of shares, and how many terms of a source are reported.
LEAST_DOCS, SCALE, TERMS = 3, 1_000_000_000, 200
#: Counts that a task gathers before it passes them on, and documents between two looks at their number.
GATHERED, STRIDE = 400_000, 256
#: A task sums up pairs in tables of up to four times this number squared. Terms of more sources are summed up by slices.
TABLE = 1_024
#: (language, source) groups up to which their totals are broadcast; beyond, they are joined by shuffling.
FEW_GROUPS = 100_000
#: Letters as they count, A-Z in lower case; all other ASCII divides.
_LETTERS = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters and of characters beyond ASCII, in order."""
    return (text or b"").translate(_LETTERS).split()


def _named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    text = lambda c, name: F.coalesce(column(c).cast("string"), F.lit("")).alias(name)
    return docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text").cast("binary").alias("text"))


def _counted(named: DataFrame) -> DataFrame:
    """(key, source, block, docs, n): a block's documents with the term, and how often they have it. The key is the term, a
    zero byte, which no term holds, and the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        block = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for (lang, source), (n, docs) in held.items():
                found = list(n)
                if found:
                    of_lang = b"\0" + lang.encode()
                    columns = [pa.array([t + of_lang for t in found], pa.binary()), pa.repeat(source, len(found)), pa.repeat(pa.scalar(block, pa.int32()), len(found))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([docs[t] for t in found], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["key", "source", "block", "docs", "n"])
            held.clear()
            block += 1

        for batch in batches:
            for at in range(0, batch.num_rows, STRIDE):
                some = batch.slice(at, STRIDE)
                for lang, source, text in zip(*(c.to_pylist() for c in some.columns)):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    words = terms(text)
                    n.update(words)
                    docs.update(set(words))
                if sum(len(n) for n, _ in held.values()) > GATHERED:
                    yield from passed_on()
        yield from passed_on()

    return named.mapInArrow(run, "key binary, source string, block int, docs bigint, n bigint")


def _sorted(counted: DataFrame) -> DataFrame:
    """The counts dealt by key and sorted by key, source and block. A sort compares the first eight bytes of the first column
    before it reads the rows: these tell most terms apart, but not languages, so the key begins with the term."""
    return counted.repartition("key").sortWithinPartitions("key", "source", "block")


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        values = table.column(c)
        new[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy()
    return new


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted counts → (lang, term, total, sources, counts) of each term with enough documents. A run that the batch does
    not end is carried on, a row for each source."""
    names = ["key", "source", "docs", "n"]
    carried = None
    for batch in _and_end(batches):
        parts = [x for x in (carried, batch) if x is not None]
        if not parts:
            return
        table = pa.Table.from_batches([p.select(names) for p in parts]).combine_chunks()
        if not table.num_rows:
            continue
        of_term = _starts(table, ["key"])
        at = np.flatnonzero(of_term | _starts(table, ["source"]))
        sums = {c: np.add.reduceat(table.column(c).to_numpy(), at) for c in ("docs", "n")}
        first = np.flatnonzero(of_term[at])  # among the runs of sources, those that begin a term
        merged = table.take(pa.array(at)).select(names[:2]).append_column("docs", pa.array(sums["docs"])).append_column("n", pa.array(sums["n"]))
        whole = len(first) if batch is None else len(first) - 1
        carried = None if batch is None else merged.slice(first[-1]).combine_chunks().to_batches()[0]
        kept = np.flatnonzero(np.add.reduceat(sums["docs"], first)[:whole] >= LEAST_DOCS)
        if len(kept):
            ends = np.append(first, len(at))
            rows = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in kept])
            offsets = pa.array(np.append(0, np.cumsum(ends[kept + 1] - ends[kept])).astype(np.int32))
            flat = merged.take(pa.array(rows)).combine_chunks()
            lists = [pa.ListArray.from_arrays(offsets, flat.column(c).combine_chunks()) for c in ("source", "n")]
            told = [key.split(b"\0", 1) for key in merged.column("key").take(pa.array(first[kept])).to_pylist()]
            heads = pa.array([lang.decode() for _, lang in told], pa.string()), pa.array([term for term, _ in told], pa.binary())
            yield pa.RecordBatch.from_arrays([*heads, pa.array(np.add.reduceat(sums["n"], first)[kept]), *lists], names=["lang", "term", "total", "sources", "counts"])
        if batch is None:
            return


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly; null without kept terms."""
    above = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    of = F.nullif((total + kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return _div(above, of) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers below 2^31."""
    return _div((p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p[:, None] - q[None, :]
    return apart * apart // q[None, :]


class _Sums:
    """Sums over pairs of sources, a square table for each language."""

    def __init__(self):
        self.places: dict[str, dict[str, int]] = {}
        self.tables: dict[str, np.ndarray] = {}

    def at(self, lang: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(table, places) of some sources; the table grows with the sources."""
        places = self.places.setdefault(lang, {})
        found = np.array([places.setdefault(s, len(places)) for s in names])
        table = self.tables.get(lang, np.zeros((0, 0), np.int64))
        if len(places) > len(table):
            grown = np.zeros((2 * len(places),) * 2, np.int64)
            grown[: len(table), : len(table)] = table
            self.tables[lang] = table = grown
        return table, found

    def cells(self) -> int:
        return sum(t.size for t in self.tables.values())

    def told(self) -> Iterator[pa.RecordBatch]:
        """All sums that are not zero, which are then forgotten."""
        for lang, table in self.tables.items():
            a, b = np.nonzero(table)
            names = list(self.places[lang])
            yield _partial(lang, names, names, a, b, table[a, b])
        self.places, self.tables = {}, {}


def _partial(lang: str, left: list[str], right: list[str], a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(left).take(pa.array(a)), pa.array(right).take(pa.array(b)), pa.array(value)], names=["lang", "source", "item", "value"])


def _extra(p: np.ndarray, zero: np.ndarray, q: np.ndarray, zero_q: np.ndarray) -> np.ndarray:
    """By how much the gaps of a term that both have differ from what the rules for absent terms would add."""
    return _gaps(p, q) - _gaps(p, zero_q) - _gaps(zero, q) + _gaps(zero, zero_q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, p, zero), the rows of a term together → partial (lang, source, item, value): :func:`_extra` summed
    over all terms that both sources have."""
    sums, carried = _Sums(), None
    for batch in _and_end(batches):
        parts = [x for x in (carried, batch) if x is not None]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        if not rows.num_rows:
            continue
        first = np.flatnonzero(_starts(rows, ["lang", "term"]))
        ends = np.append(first, rows.num_rows)
        carried = None if batch is None else rows.slice(first[-1]).combine_chunks().to_batches()[0]
        sources, p, zero = rows.column("source").to_pylist(), rows.column("p").to_numpy(), rows.column("zero").to_numpy()
        langs = rows.column("lang").take(pa.array(first)).to_pylist()
        for k in range(len(first) if batch is None else len(first) - 1):
            at, end = first[k], ends[k + 1]
            if end - at <= TABLE:
                table, places = sums.at(langs[k], sources[at:end])
                table[np.ix_(places, places)] += _extra(p[at:end], zero[at:end], p[at:end], zero[at:end])
                if sums.cells() > 4 * TABLE * TABLE:
                    yield from sums.told()
                continue
            for i in range(at, end, TABLE):
                for j in range(at, end, TABLE):
                    x, y = slice(i, min(i + TABLE, end)), slice(j, min(j + TABLE, end))
                    part = _extra(p[x], zero[x], p[y], zero[y])
                    a, b = np.nonzero(part)
                    yield _partial(langs[k], sources[x], sources[y], a, b, part[a, b])
    yield from sums.told()


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by which terms.

    A language keeps the terms of at least LEAST_DOCS documents. With ``count`` occurrences of a kept term out of N, a
    source (or the language) gives it the share p = 1 + floor(10^9 (count + 1) / (N + V)), V being the number of kept
    terms; the gap of p from q is floor((p - q)^2 / q). Part ``pair`` sums the gaps from another source over all kept
    terms, present or not; part ``term`` lists up to TERMS terms that the source has and that have more than the
    language's share. Ranks start with the largest value, ties go by the item's bytes.

    Null texts, languages and sources are empty strings; a text without terms still makes its source a group; repeated
    rows are documents each; other columns, whatever their names, are left out; an empty table gives no rows. Texts are
    read once, whole; counts are added up before they move, and no task holds more than a term's sources.
    """
    named = _named(docs, lang_col, source_col, text_col)
    kept, _ = materialise(_sorted(_counted(named)).mapInArrow(_runs, "lang string, term binary, total bigint, sources array<string>, counts array<bigint>"), "kept")
    posted = kept.select("lang", "term", "total", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("has"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    groups, _ = materialise(named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", none("size"), none("has"), none("v"), none("all")).withColumn("zero", _share(F.lit(0).cast("bigint"), F.col("size"), F.col("v"))), "groups")
    few = groups.count() <= FEW_GROUPS
    told = posted.join(F.broadcast(groups) if few else groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("size"), F.col("v")))

    q = _share(F.col("total"), F.col("all"), F.col("v"))
    terms_ = told.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms_ = terms_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TERMS)

    together = told.select("lang", "term", "source", "p", "zero")
    if not few:
        together = together.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = together.mapInArrow(_pairs, "lang string, source string, item string, value bigint").where("source <> item")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.col("has").alias("other_has"))
    alike = told.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).join(other, "lang").where("source <> item")
    one = alike.select("lang", "source", "item", (F.col("times") * _gap(F.col("p"), F.col("other"))).alias("value"))
    two = alike.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * _gap(F.col("other"), F.col("p"))).alias("value"))
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce((F.col("v") - F.col("has") - F.col("other_has")) * _gap(F.col("zero"), F.col("other")), F.lit(0).cast("bigint")).alias("value"))
    pairs = both.unionByName(one).unionByName(two).unionByName(neither).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms_)

"""Operator 7: chat formatting, with cumulative snapshots collapsed.

A log often holds a conversation once for every turn, each copy a prefix of the next. A rolling hash over the turns
gives every prefix of every conversation a number; conversations whose last hash is another's proper prefix go, equal
ones stay once, and the maximal ones are rendered. Texts are moved once, to bring the turns into order; all the rest
carries hashes only, until the turns of the maximal conversations are joined where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Turns rendered into one row; a conversation of more turns has several parts.
PART_TURNS = 256
#: The rolling hash: sums of as many hashes of (place, role, text), each modulo a prime below 2^31.
SUMS, PRIME = 3, 2_147_483_647
#: Characters of a text that ranges are told apart by; within a range the order is by whole texts.
RANGE_CHARS = 256


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def ordered_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, role, text, range, id, c0, c1): the turns by conversation, number (nulls first), role and text; ``id``
    rises by one in a range, c0 and c1 hash role and text.

    One range sort, so that a conversation with very many turns spreads over tasks. This is the one time texts move.
    """
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))
    keys = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*keys, F.left("text", F.lit(RANGE_CHARS)), F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*keys, "text")
    content = (F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashes = (F.xxhash64(F.lit(k), *content).alias(f"c{k}") for k in range(2))
    out, _ = materialise(dealt.select("conv_id", "role", "text", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("id"), *hashes), "turns")
    return out


def spans(ordered: DataFrame) -> DataFrame:
    """(range, conv_id, first, n, before, total): where a conversation lies in a range, its turns in earlier ones and in all."""
    parts = ordered.groupBy("range", "conv_id").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(conv.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out, _ = materialise(parts.withColumns({"before": before, "total": F.sum("n").over(conv)}), "spans")
    return out


def prefix_hashes(ordered: DataFrame, where: DataFrame) -> DataFrame:
    """(conv_id, pos, total, p0, p1): a row for each turn with its place from 0 and the hash of its conversation up to it.

    A hash is a sum over the turns, taken within a range and carried on from the totals of the ranges before. Only the
    conversations at the borders of ranges have such: at most two rows a range are broadcast.
    """
    thin = ordered.select("range", "conv_id", "id", "c0", "c1")
    placed = thin.join(where, _same(thin, where, "range", "conv_id")).select(thin["range"], thin["conv_id"], (F.col("id") - F.col("first") + F.col("before")).alias("pos"), "n", "total", "c0", "c1")
    terms = placed.select("range", "conv_id", "pos", "n", "total", *(F.pmod(F.xxhash64("c0", "c1", "pos", F.lit(k)), F.lit(PRIME)).alias(f"t{k}") for k in range(SUMS)))
    upto = Window.partitionBy("range", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.select("*", *(F.sum(f"t{k}").over(upto).alias(f"u{k}") for k in range(SUMS)))
    cut = terms.where("n < total").groupBy("range", "conv_id").agg(*(F.sum(f"t{k}").alias(f"s{k}") for k in range(SUMS)))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(cut.select("range", "conv_id", *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in range(SUMS))))
    full = summed.join(carried, _same(summed, carried, "range", "conv_id"), "left")
    sums = [F.pmod(F.col(f"u{k}") + F.coalesce(f"b{k}", F.lit(0)), F.lit(PRIME)) for k in range(SUMS)]
    return full.select(summed["conv_id"], "pos", "total", F.xxhash64("pos", *sums).alias("p0"), F.xxhash64(*sums, "pos").alias("p1"))


def maximal(hashed: DataFrame) -> DataFrame:
    """The ids (conv_id) of the conversations that are no proper prefix of another; of equal ones the smallest.

    One aggregation over the hashes: a conversation is maximal if its last one is nowhere but at ends. A first turn
    that very many conversations share is combined before it is moved.
    """
    last = F.col("pos") == F.col("total") - 1
    ends = hashed.groupBy("p0", "p1").agg(F.count("*").alias("n"), F.count_if(last).alias("ends"), F.min(F.when(last, F.col("conv_id"))).alias("conv_id"))
    return ends.where("n = ends").select("conv_id")


def _join_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, pos, total, text) → (conv, part, total, first, n, text): what follows on in one part is joined."""
    held: list = []  # conv as a one-row array, its value, pos of the first turn, total, texts

    def piece() -> pa.RecordBatch:
        conv, _, first, total, texts = held
        numbers = [pa.array([first // PART_TURNS], pa.int32()), pa.array([total], pa.int64()), pa.array([first], pa.int64()), pa.array([len(texts)], pa.int64())]
        return pa.RecordBatch.from_arrays([conv, *numbers, pa.array(["".join(texts)], pa.string())], names=["conv_id", "part", "n_turns", "first", "n", "rendered"])

    for batch in batches:
        for k, (conv, pos, total, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if held and conv == held[1] and pos == held[2] + len(held[4]) and pos % PART_TURNS:
                held[4].append(text)
                continue
            if held:
                yield piece()
            held = [batch.column(0).slice(k, 1), conv, pos, total, [text]]
    if held:
        yield piece()


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, rendered): the maximal conversations in ChatML, PART_TURNS turns a row.

    A null role is rendered as ``unknown``, a null text as nothing, but neither equals a value in comparisons. Tied turn
    numbers go by role, then text. A null conversation id is one conversation of its own. Repeated rows are turns each.
    An empty table gives no rows; other columns, whatever their names, are left out. The parts of a conversation, joined
    in order, are its whole text, however long; a task holds one part's.

    Parts that lie in one range are joined there; only those cut by the border of a range are moved once more.
    """
    ordered = ordered_turns(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    where = spans(ordered)
    keep = maximal(prefix_hashes(ordered, where)).withColumnRenamed("conv_id", "kept")
    kept, _ = materialise(where.join(keep, where["conv_id"].eqNullSafe(keep["kept"]), "left_semi"), "kept")
    shown = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    lines = ordered.join(kept, _same(ordered, kept, "range", "conv_id")).select(ordered["conv_id"], (F.col("id") - F.col("first") + F.col("before")).alias("pos"), "total", shown.alias("s"))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    pieces, _ = materialise(lines.sortWithinPartitions("conv_id", "pos").mapInArrow(_join_turns, f"conv_id {kind}, part int, n_turns bigint, first bigint, n bigint, rendered string"), "parts")
    whole = F.col("n") == F.least(F.lit(PART_TURNS), F.col("n_turns") - F.col("part") * PART_TURNS)
    cut = pieces.where(~whole).groupBy("conv_id", "part", "n_turns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "rendered"))), lambda x: x["rendered"]), "").alias("rendered"))
    return pieces.where(whole).select("conv_id", "part", "n_turns", "rendered").unionByName(cut)

"""Workbook reconciliation (JN-07 to JN-14, FN-33 to FN-36, AGG-04 to AGG-06) over cells in long form.

A cell is (book 'a' or 'b', sheet, row, col, header, value); of a cell that stands twice the least value counts. Each
sheet is planned from its headers (columns and keys); rows are packed once and meet once, matched or alone, with their
cells (:func:`matched`). Everything else reads that one table.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def header_ratio(a: str, b: str) -> float:
    """FN-41."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def match_columns(a: list[str], b: list[str], norm_a: list[str], norm_b: list[str]) -> list[tuple[int, int]]:
    """JN-08: equal normalised headers, then the most alike above the limit, then by place. Positions of a and b."""
    free, pairs = list(range(len(b))), []
    rest = []
    for i, x in enumerate(norm_a):
        hit = next((j for j in free if norm_b[j] == x and x), None)
        if hit is None:
            rest.append(i)
        else:
            free.remove(hit)
            pairs.append((i, hit))
    still = []
    for i in rest:
        scored = [(header_ratio(norm_a[i], norm_b[j]), -j) for j in free]
        best = max(scored, default=(0.0, 0))
        if best[0] > vocab.FUZZY_HEADER:
            free.remove(-best[1])
            pairs.append((i, -best[1]))
        else:
            still.append(i)
    return sorted([*pairs, *zip(still, free)])


#: Sheets whose plans are broadcast; a larger number of plans is joined by shuffling.
FEW_SHEETS = 20_000
_PAIRS = "array<struct<col_a:int,col_b:int,name:string>>"


def column_map(cells: DataFrame) -> DataFrame:
    """JN-08: (sheet, col_a, col_b, name): matched columns of each sheet."""
    heads = cells.select("book", "sheet", "col", "header").distinct().withColumns({"is_key": F.lit(False)})
    return _planned(heads).select("sheet", F.inline("pairs"))


def _planned(heads: DataFrame) -> DataFrame:
    """(sheet, pairs, keys): matched columns and, of these, key columns of each sheet. A group holds the distinct headers
    of one sheet: (book, sheet, col, header, is_key)."""

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[group.book == k].sort_values("col") for k in "ab")
        if a.empty or b.empty:
            return pd.DataFrame([], columns=["sheet", "pairs", "keys"])
        found = match_columns(list(a.header), list(b.header), list(a.norm), list(b.norm))
        pairs = [{"col_a": int(a.col.iloc[i]), "col_b": int(b.col.iloc[j]), "name": a.header.iloc[i]} for i, j in found]
        keys = [k for k, (i, _) in enumerate(found) if a.is_key.iloc[i]]
        return pd.DataFrame([(group.sheet.iloc[0], pairs, [pairs[k] for k in keys])], columns=["sheet", "pairs", "keys"])

    normed = heads.select("book", "sheet", "col", "header", T.header(F.col("header")).alias("norm"), "is_key")
    return normed.groupBy("sheet").applyInPandas(plan, f"sheet string, pairs {_PAIRS}, keys {_PAIRS}")


def _few(table: DataFrame) -> DataFrame:
    """A table of a row for each sheet, at hand where it is small."""
    found = table.limit(FEW_SHEETS + 1).toArrow()
    return F.broadcast(table.sparkSession.createDataFrame(found, table.schema)) if found.num_rows <= FEW_SHEETS else table


def key_columns(cells: DataFrame) -> DataFrame:
    """AGG-06: (sheet, col, header, n, n_distinct, is_key) of book a: distinct non-empty values over all of them."""
    stats = cells.where("book = 'a' and value <> ''").groupBy("sheet", "col", "header").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"))
    return stats.withColumn("is_key", _is_id(F.col("header")) & (F.col("n_distinct") / F.col("n") >= vocab.KEY_UNIQUENESS))


def filled(value: Column) -> Column:
    """Whether a cell holds something: neither nothing nor a number that is zero. Blanks and texts like "0%" count."""
    return (value != "") & ~F.rlike(value, F.lit(vocab.ZERO))


def filled(value: Column) -> Column:
    """Whether a cell holds something: neither nothing nor a number that is zero. Blanks and texts like "0%" count."""
    return (value != "") & ~F.rlike(value, F.lit(vocab.ZERO))


def _is_id(header: Column) -> Column:
    return T.any_in(F.lower(header), [w.lower() for w in vocab.ID_HEADERS])


def _plans(cells: DataFrame, keys: list[int] | int | None) -> DataFrame:
    """:func:`_planned` with the given key columns of book a, or those of AGG-06: named like one and distinct in most rows.
    One aggregation of the cells; only values that may be keys are counted apart."""
    heads = ["book", "sheet", "col", "header"]
    if keys is not None:
        found = cells.select(*heads).distinct().withColumn("is_key", (F.col("book") == "a") & F.col("col").isin([keys] if isinstance(keys, int) else keys))
    else:
        value = F.when((F.col("book") == "a") & (F.col("value") != "") & _is_id(F.col("header")), F.col("value"))
        found = cells.withColumn("v", value).groupBy(*heads).agg(F.count("v").alias("n"), F.count_distinct("v").alias("d")).withColumn("is_key", F.coalesce(F.col("d") / F.nullif("n", F.lit(0)) >= vocab.KEY_UNIQUENESS, F.lit(False)))
    return _planned(found)


def _value(cells: Column, col: Column) -> Column:
    return F.coalesce(F.element_at(F.map_from_entries(cells), col), F.lit(""))


def matched(cells: DataFrame, keys: list[int] | int | None = None, *, by_position: bool = True) -> DataFrame:
    """JN-12, the root of the comparison: (sheet, how, row_a, row_b, cells_a, cells_b, pairs) of all rows that hold something.

    A sheet's rows match by ``keys``, columns of book a whose place in book b the column map tells, or by the key columns
    that AGG-06 finds: the k-th row of a key with the k-th (JN-09). Where there are none, or where no row finds a
    partner, rows match that have one number (JN-10), if ``by_position`` is on. A row without a partner has nulls on the
    other side; so has, in a sheet with keys, a row whose keys are blank. Header rows are rows like others if they are
    among the cells. Sheets of one book have no rows here. ``cells`` are (col, value) in order, ``pairs`` the matched
    columns.

    Cells move once to their rows, and rows once to their partners.
    """
    plans = _few(_plans(cells, keys))
    packed = cells.groupBy("book", "sheet", "row").agg(F.max(filled(F.col("value"))).alias("held"), F.array_sort(F.collect_list(F.struct("col", "value"))).alias("all")).where("held")
    once = F.filter("all", lambda c, i: (i == 0) | (F.get(F.col("all"), i - 1)["col"] != c["col"]))
    here = F.when(F.col("book") == "a", F.lit("a")).otherwise("b")
    parts = F.transform("keys", lambda k: T.strip(_value(F.col("cells"), F.when(here == "a", k["col_a"]).otherwise(k["col_b"]))))
    rows = packed.withColumn("cells", once).join(plans, "sheet").withColumn("parts", parts)
    rows = rows.select("book", "sheet", "row", "cells", "pairs", F.when(F.exists("parts", lambda v: v != ""), F.array_join("parts", "||")).alias("key"))
    if by_position:
        met = rows.where("key is not null").groupBy("sheet", "key").agg(F.count_distinct("book").alias("n")).groupBy("sheet").agg(F.max(F.col("n") == 2).alias("works"))
        rows = rows.join(_few(met), "sheet", "left").withColumn("works", F.coalesce("works", F.lit(False)))
    else:
        rows = rows.withColumn("works", F.lit(True))
    at = F.when(~F.col("works"), F.concat(F.lit("#"), "row")).when(F.col("key").isNotNull(), F.concat(F.lit("="), "key")).otherwise(F.concat(F.lit("?"), "book", "row"))
    nth = F.row_number().over(Window.partitionBy("sheet", "at", "book").orderBy("row"))
    dealt = rows.withColumn("at", at).repartition("sheet", "at").withColumn("nth", nth)
    side = lambda b, c, name: F.first(F.when(F.col("book") == b, F.col(c)), ignorenulls=True).alias(name)
    both = dealt.groupBy("sheet", "at", "nth").agg(side("a", "row", "row_a"), side("b", "row", "row_b"), side("a", "cells", "cells_a"), side("b", "cells", "cells_b"), F.first("pairs").alias("pairs"), F.first("works").alias("works"))
    return both.select("sheet", F.when(F.col("works"), "key").otherwise("position").alias("how"), "row_a", "row_b", "cells_a", "cells_b", "pairs")


def match_rows(cells: DataFrame, keys: list[int] | int) -> DataFrame:
    """JN-09: (sheet, row_a, row_b) by the given key columns alone."""
    return matched(cells, keys, by_position=False).select("sheet", "row_a", "row_b")


def match_rows_auto(cells: DataFrame) -> DataFrame:
    """JN-12: (sheet, row_a, row_b, how), see :func:`matched`."""
    return matched(cells).select("sheet", "row_a", "row_b", "how")


_DIFFERENCE = ["sheet", "type", "row", "col", "col_name", "value_a", "value_b", "category", "risk"]


def _compared(rows: DataFrame, tolerance: float) -> DataFrame:
    """The differences of matched rows, and rows without a partner, one after the other."""
    both = F.col("row_a").isNotNull() & F.col("row_b").isNotNull()
    a, b = F.map_from_entries("cells_a"), F.map_from_entries("cells_b")
    value = lambda of, col: F.coalesce(F.element_at(of, col), F.lit(""))
    spots = T.let(F.struct(a.alias("a"), b.alias("b")), lambda m: F.filter(F.transform("pairs", lambda p: F.struct(p["col_a"].alias("col"), p["name"].alias("col_name"), value(m["a"], p["col_a"]).alias("value_a"), value(m["b"], p["col_b"]).alias("value_b"))), lambda c: c["value_a"] != c["value_b"]))
    line = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: c["value"]), lambda v: v != ""), " ")
    lone = F.array(F.struct(F.lit(-1).alias("col"), F.lit("").alias("col_name"), line(F.col("cells_a")).alias("value_a"), line(F.col("cells_b")).alias("value_b")))
    each = rows.select("sheet", "row_a", "row_b", F.inline(F.when(both, spots).otherwise(lone)))
    na, nb = T.cell_number(F.col("value_a")), T.cell_number(F.col("value_b"))
    kind = F.when(F.col("row_b").isNull(), "row_deleted").when(F.col("row_a").isNull(), "row_added").otherwise("cell_changed")
    found = each.withColumn("type", kind).withColumn("category", F.when(F.col("type") == "cell_changed", T.cell_category(F.col("value_a"), F.col("value_b"), F.col("col_name"))).otherwise("text"))
    close = (F.col("category") == "number") & F.coalesce(F.abs(na - nb) <= tolerance, F.lit(False))
    same = (F.col("type") == "cell_changed") & ((T.cell(F.col("value_a")) == T.cell(F.col("value_b"))) | close)
    risk = F.when(F.col("type") == "cell_changed", T.cell_risk(F.col("category"), F.col("col_name"))).otherwise("medium")
    return found.where(~same).select("sheet", "type", F.coalesce("row_a", "row_b").alias("row"), "col", "col_name", "value_a", "value_b", "category", risk.alias("risk"))


def differences(cells: DataFrame, keys: list[int] | int | None = None, *, tolerance: float = 0.01, moves: bool = False) -> DataFrame:
    """All differences of the sheets that both books have: (sheet, type, row, col, col_name, value_a, value_b, category,
    risk). ``type`` is cell_changed, row_deleted or row_added; with ``moves`` pairs of the latter two that are alike are one
    row_moved each. Rows without a partner have column -1 and their filled cells as a line on their side."""
    found = _compared(matched(cells, keys), tolerance)
    if not moves:
        return found
    moved = moved_rows(cells, keys)
    gone = moved.select("sheet", F.inline(F.array(F.struct(F.lit("row_deleted").alias("type"), F.col("row_a").alias("row")), F.struct(F.lit("row_added").alias("type"), F.col("row_b").alias("row")))))
    as_one = moved.select("sheet", F.lit("row_moved").alias("type"), F.col("row_a").alias("row"), F.lit(-1).alias("col"), F.lit("").alias("col_name"), F.col("line_a").alias("value_a"), F.col("line_b").alias("value_b"), F.lit("text").alias("category"), F.lit("low").alias("risk"))
    return found.join(gone, ["sheet", "type", "row"], "left_anti").select(*_DIFFERENCE).unionByName(as_one)


def cell_differences(cells: DataFrame, keys: list[int] | int | None = None, tolerance: float = 0.01) -> DataFrame:
    """FN-36: sheet, row, col, col_name, value_a, value_b, category, risk of matched rows' cells that differ. A cell that
    one side does not have is empty there."""
    return differences(cells, keys, tolerance=tolerance).where("type = 'cell_changed'").drop("type")


def row_changes(cells: DataFrame, keys: list[int] | int | None = None) -> DataFrame:
    """JN-14: (sheet, type, row) of rows without a partner."""
    lone = matched(cells, keys).where("row_a is null or row_b is null")
    return lone.select("sheet", F.when(F.col("row_b").isNull(), "row_deleted").otherwise("row_added").alias("type"), F.coalesce("row_a", "row_b").alias("row"))


#: Lengths of rows fall into classes a factor of 7/3 wide: rows further apart than neighbouring classes cannot be alike
#: by more than 0.6, whose bound 2 min / (m + n) that factor meets. Rows of a class meet in blocks of so many.
_LENGTHS, _BLOCK = 7 / 3, 64


def _longest_common(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each of ``a`` with each of ``b``, b by rows: bits of the lines of a,
    in words of 64, are moved by a character of each line of b at a time."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (*a, *b)]
    known = np.unique(np.concatenate(codes))
    words = max(1, -(-max(map(len, a), default=0) // 64))
    of = np.zeros((words, len(known) + 1, len(a)), np.uint64)  # the last code is that of no character
    for k, line in enumerate(codes[: len(a)]):
        at = np.arange(len(line))
        np.bitwise_or.at(of, (at // 64, np.searchsorted(known, line), k), np.uint64(1) << (at % 64).astype(np.uint64))
    text = np.full((max(map(len, b), default=0), len(b)), len(known))
    for k, line in enumerate(codes[len(a) :]):
        text[: len(line), k] = np.searchsorted(known, line)
    left = np.full((words, len(b), len(a)), ~np.uint64(0))
    for row in text:
        carry = None
        for w in range(words):
            v = left[w]
            met = v & of[w][row]
            moved = v + met
            if words > 1:
                over = moved < v
                if carry is not None:
                    moved += carry
                    over |= moved < carry
                carry = over.astype(np.uint64)
            left[w] = moved | (v - met)
    return 64 * words - np.bitwise_count(left).sum(axis=0, dtype=np.int64)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sheet, rows_a, lines_a, rows_b, lines_b) of two blocks → (sheet, row_a, row_b, ratio, line_a, line_b) of the pairs
    that are alike. The likeness is that of a common subsequence, so the longest one bounds it, and leaves few to compare."""
    names = ["sheet", "row_a", "row_b", "ratio", "line_a", "line_b"]
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            sheet, rows_a, a, rows_b, b = (c[k].as_py() for c in batch.columns)
            both = np.add.outer([len(x) for x in b], [len(x) for x in a])
            bound = 2.0 * _longest_common(a, b) / np.maximum(both, 1)
            for j, i in zip(*np.nonzero(bound > vocab.MOVED_ROW)):
                ratio = header_ratio(a[i], b[j])
                if ratio > vocab.MOVED_ROW:
                    out.append((sheet, rows_a[i], rows_b[j], ratio, a[i], b[j]))
        kinds = [batch.schema.field(0).type, batch.schema.field(1).type.value_type, batch.schema.field(3).type.value_type, pa.float64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([row[n] for row in out], kind) for n, kind in enumerate(kinds)], names=names)


def moved_rows(cells: DataFrame, keys: list[int] | int | None = None) -> DataFrame:
    """JN-13: (sheet, row_a, row_b, ratio, line_a, line_b): each deleted row, in order, takes the most alike free added row of
    its sheet above the limit, the first of equals.

    Rows meet in blocks, by sheet and class of length; two blocks are dealt like any others, so that a large sheet is no
    single task. What is alike is decided there; only (row, row, ratio) goes by sheet, as a sorted stream that remembers
    the rows taken.
    """
    line = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: c["value"]), lambda v: v != ""), " ")
    lone = matched(cells, keys).where("row_a is null or row_b is null").select("sheet", F.col("row_a").isNotNull().alias("gone"), F.coalesce("row_a", "row_b").alias("row"), line(F.coalesce("cells_a", "cells_b")).alias("line"))
    told = lone.withColumn("class", F.floor(F.log(F.greatest(F.length("line"), F.lit(1))) / F.log(F.lit(_LENGTHS))).cast("int"))
    nth = F.row_number().over(Window.partitionBy("sheet", "gone", "class").orderBy("row"))
    blocks = told.withColumn("block", F.floor((nth - 1) / _BLOCK)).groupBy("sheet", "gone", "class", "block").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("rows"))
    side = lambda s: [F.col("block").alias(f"block_{s}"), F.col("rows.row").alias(f"rows_{s}"), F.col("rows.line").alias(f"lines_{s}")]
    old = blocks.where("gone").select("sheet", "class", *side("a"))
    new = blocks.where("not gone").select("sheet", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"), *side("b"))
    spark = cells.sparkSession
    met = old.join(new, ["sheet", "class"]).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sheet", "class", "block_a", "block_b")
    kind = {f.name: f.dataType.simpleString() for f in lone.schema}
    scored = met.select("sheet", "rows_a", "lines_a", "rows_b", "lines_b").mapInArrow(_scored, f"sheet {kind['sheet']}, row_a {kind['row']}, row_b {kind['row']}, ratio double, line_a string, line_b string")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheet, taken, placed = None, set(), None
        for batch in batches:
            keep = []
            for s, a, b in zip(batch.sheet, batch.row_a, batch.row_b):
                if s != sheet:
                    sheet, taken, placed = s, set(), None
                free = a != placed and b not in taken
                if free:
                    taken.add(b)
                    placed = a
                keep.append(free)
            yield batch[keep]

    ordered = scored.repartition("sheet").sortWithinPartitions("sheet", "row_a", F.desc("ratio"), "row_b")
    return ordered.mapInPandas(take, ordered.schema)


def sheet_stats(cells: DataFrame, keys: list[int] | int | None = None) -> DataFrame:
    """AGG-04: sheet, added, deleted, modified, has_high of the sheets with differences; counts are those before moves are
    found."""
    n = lambda t: F.count_if(F.col("type") == t)
    return differences(cells, keys).groupBy("sheet").agg(n("row_added").alias("added"), n("row_deleted").alias("deleted"), n("cell_changed").alias("modified"), F.bool_or(F.col("risk") == "high").alias("has_high"))


def sheet_presence(cells: DataFrame) -> DataFrame:
    """JN-07: (sheet, in_a, in_b, status): the full outer join of both books' sheets by name, as one aggregation. With a
    column ``sheet_no`` also ``place``: the first book's sheets in their order, then those that the second alone has."""
    has = lambda b: F.bool_or(F.col("book") == b)
    status = F.when(F.col("in_a") & F.col("in_b"), "matched").when(F.col("in_a"), "only_in_a").otherwise("only_in_b").alias("status")
    if "sheet_no" not in cells.columns:
        return cells.groupBy("sheet").agg(has("a").alias("in_a"), has("b").alias("in_b")).select("sheet", "in_a", "in_b", status)
    least = lambda b: F.min(F.when(F.col("book") == b, F.col("sheet_no")))
    found = cells.groupBy("sheet").agg(has("a").alias("in_a"), has("b").alias("in_b"), least("a").alias("no_a"), least("b").alias("no_b"))
    place = F.row_number().over(Window.orderBy(~F.col("in_a"), F.coalesce("no_a", "no_b"), "sheet"))  # a row for each sheet
    return found.select("sheet", "in_a", "in_b", status, place.alias("place"))


def workbook_summary(cells: DataFrame, keys: list[int] | int | None = None) -> DataFrame:
    """AGG-05 with JN-07: sheets, total differences and whether one is critical; a sheet on one side counts all its rows,
    its header too."""
    sheets = cells.groupBy("sheet").agg(F.bool_or(F.col("book") == "a").alias("a"), F.bool_or(F.col("book") == "b").alias("b"), (F.count_distinct("row") + 1).alias("rows"))
    both = sheets.join(sheet_stats(cells, keys), "sheet", "left")
    status = F.when(F.col("a") & F.col("b"), "matched").when(F.col("a"), "only_in_a").otherwise("only_in_b")
    return both.select("sheet", status.alias("status"), F.when(F.col("a") & F.col("b"), F.coalesce(F.col("added") + F.col("deleted") + F.col("modified"), F.lit(0))).otherwise(F.col("rows")).alias("differences"), (F.coalesce("has_high", F.lit(False)) | ~(F.col("a") & F.col("b"))).alias("critical"))


def by_position(cells: DataFrame) -> DataFrame:
    """JN-10: (sheet, row) of rows that have content on both sides."""
    return cells.where(filled(F.col("value"))).groupBy("sheet", "row").agg(F.count_distinct("book").alias("n")).where("n = 2").select("sheet", "row")


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """SRC-13: a merged range (book, sheet, r0, r1, c0, c1) gives its top left value to all its cells.

    Ranges are met by book, sheet and row, one row of ``ranges`` for each row it covers, so the join is on keys.
    """
    corners = cells.select("book", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("fill"))
    spots = ranges.join(corners, ["book", "sheet", "r0", "c0"]).select("book", "sheet", F.explode(F.sequence("r0", "r1")).alias("row"), F.col("c0").alias("from_col"), F.col("c1").alias("to_col"), "fill").alias("s")
    met = cells.alias("c").join(spots, F.expr("c.book = s.book and c.sheet = s.sheet and c.row = s.row and c.col between s.from_col and s.to_col"), "left")
    return met.select("c.book", "c.sheet", "c.row", "c.col", F.coalesce("s.fill", "c.value").alias("value"))


def rows_to_text(cells: DataFrame) -> DataFrame:
    """SRC-14: (book, sheet, row, line): the filled cells as ``name: value``."""
    return _lines(cells).drop("no")


def _lines(cells: DataFrame) -> DataFrame:
    no = F.min("sheet_no") if "sheet_no" in cells.columns else F.first(F.lit(0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("col", "header", "value"))), lambda x: F.concat_ws(": ", x["header"], x["value"]))
    joined = cells.where("value <> ''").groupBy("book", "sheet", "row").agg(no.alias("no"), F.array_join(parts, " | ").alias("joined"))
    return joined.select("book", "sheet", "row", F.concat(F.lit("行"), F.col("row"), F.lit(": "), F.col("joined")).alias("line"), "no")


def infer_headers(cells: DataFrame) -> DataFrame:
    """SRC-12: (book, sheet, col, header): the first row that holds something, else the first; an empty header is named
    by its place."""
    first = cells.groupBy("book", "sheet").agg(F.coalesce(F.min(F.when(filled(F.col("value")), F.col("row"))), F.min("row")).alias("row"))
    return cells.join(first, ["book", "sheet", "row"]).select("book", "sheet", "col", F.when(F.col("value") == "", F.concat(F.lit("列"), F.col("col"))).otherwise(F.col("value")).alias("header"))


def book_text(cells: DataFrame) -> DataFrame:
    """SRC-14: (book, full_text): the lines of each sheet under its title, sheets in the order of ``sheet_no`` if there is
    such a column, else by name."""
    lines = _lines(cells).groupBy("book", "sheet").agg(F.min("no").alias("no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    titled = F.concat(F.lit("=== 工作表: "), F.col("sheet"), F.lit(" ===\n"), F.col("body"))
    return lines.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "sheet", titled.alias("t")))), lambda x: x["t"]), "\n\n").alias("full_text"))


def ratio_column(a: Column, b: Column) -> Column:
    """FN-41 on columns, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([header_ratio(p or "", q or "") for p, q in zip(x, y)])

    return ratio(a, b)

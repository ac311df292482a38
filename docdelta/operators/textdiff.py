"""Character differences of two texts (FN-73, FN-38, WIN-08, AGG-03).

Lines that stand once on either side and in one order part a pair into segments: as rows by windows (:func:`segments`), or
for the changes alone in one pass over a pair's lines (:func:`parts`). In a segment a shortest edit script is followed greedily, furthest point by furthest point (O(ND)), over
lines and then over the characters of what differs. A pair's pieces are then put in order and tidied.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Edits after which a stretch counts as replaced as a whole: a bound of the work where hardly anything is alike, in
#: place of a time-out. Time is at most its square, beside the length of the texts.
MAX_EDITS = 2_000
#: Characters of context on either side of a change.
CONTEXT = 50

#: What no edits reach on a diagonal that has left both texts.
_NOWHERE = -(10**9)

Edit = tuple[int, str]


def _run(a: Sequence, b: Sequence, x: int, y: int) -> int:
    """How long a from x and b from y are the same; long runs are compared in growing slices."""
    n, step, most = 0, 8, min(len(a) - x, len(b) - y)
    while n < most and a[x + n] == b[y + n]:
        if a[x + n : x + n + step] == b[y + n : y + n + step]:
            n, step = min(n + step, most), step * 2
        elif step > 8:
            step //= 4
        else:
            n += 1
    return n


def common(a: Sequence, b: Sequence, limit: int = MAX_EDITS) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs that a shortest edit script keeps, in order.

    The furthest place that d edits reach is known for each diagonal x - y; what d + 1 edits reach follows from it. All
    places of each d are kept to walk back. If more than ``limit`` edits are needed only the common ends are kept.
    """
    head = _run(a, b, 0, 0)
    tail = _run(a[head:][::-1], b[head:][::-1], 0, 0)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = ([(0, 0, head)] if head else []), ([(head + len(a), head + len(b), tail)] if tail else [])
    middle: list[tuple[int, int, int]] = []
    if a and b:
        reached, steps = {1: 0}, []
        for d in range(min(limit, len(a) + len(b)) + 1):
            furthest = array("i", [0]) * (2 * d + 1)
            done = False
            for k in range(-d, d + 1, 2):
                x = reached[k + 1] if k == -d or k != d and reached[k - 1] < reached[k + 1] else reached[k - 1] + 1
                inside = 0 <= x <= len(a) and 0 <= x - k <= len(b)
                x = x + _run(a, b, x, x - k) if inside else _NOWHERE
                reached[k] = furthest[k + d] = x
                if x >= len(a) and x - k >= len(b):
                    done = True
                    break
            steps.append(furthest)
            if done:
                middle = _walked(steps, len(a), len(b), head)
                break
    return [*ends[0], *middle, *ends[1]]


def _walked(steps: list[array], x: int, y: int, shift: int) -> list[tuple[int, int, int]]:
    """The kept runs on the way back from the end."""
    out = []
    for d in range(len(steps) - 1, -1, -1):
        k = x - y
        if d == 0:
            start = 0
        else:
            before = lambda j, e=d - 1, s=steps[d - 1]: s[j + e] if -e <= j <= e else -1
            down = k == -d or k != d and before(k - 1) < before(k + 1)
            start = before(k + 1) if down else before(k - 1) + 1
        if x > start:
            out.append((start + shift, start - k + shift, x - start))
        if d:
            x = start if down else start - 1
            y = x - (k + 1 if down else k - 1)
    return out[::-1]


def _scripted(a: Sequence, b: Sequence, kept: list[tuple[int, int, int]]) -> Iterator[tuple[Sequence, Sequence, Sequence]]:
    """(deleted, inserted, equal) stretches in order."""
    x = y = 0
    for i, j, n in [*kept, (len(a), len(b), 0)]:
        yield a[x:i], b[y:j], a[i : i + n]
        x, y = i + n, j + n


#: Words of ASCII letters and digits, and any other sign by itself.
_WORDS = re.compile(r"[A-Za-z0-9]+|.", re.DOTALL)


def edits(a: str, b: str, limit: int = MAX_EDITS) -> list[Edit]:
    """(-1 delete, 0 equal, 1 insert; text) in order: deletions and equals make ``a``, insertions and equals ``b``. Lines are
    compared first, then the characters of what differs; words come between them where it is longer than ``limit``."""
    out: list[Edit] = []

    def by(units: list, x: str, y: str) -> None:
        split, *finer = units
        left, right = (split(x), split(y)) if split else (x, y)
        for gone, new, same in _scripted(left, right, common(left, right, limit)):
            if finer and gone and new:
                follow("".join(gone), "".join(new), finer)
            else:
                out.extend((op, "".join(t)) for op, t in ((-1, gone), (1, new)) if t)
            if same:
                out.append((0, "".join(same)))

    def follow(x: str, y: str, units: list) -> None:
        by(units[1:] if len(units) > 1 and min(len(x), len(y)) <= limit else units, x, y)

    lines = lambda t: t.splitlines(keepends=True)
    finer = [_WORDS.findall, None]
    if min(len(lines(a)), len(lines(b))) < 2:
        follow(a, b, finer)
    else:
        by([lines, *finer], a, b)
    return out


def tidy(raw: list[Edit]) -> list[Edit]:
    """Neighbours merged, deletions before insertions; an equal stretch between two changes that is no longer than either
    of them is given up, as what it keeps means less than the changes around it."""
    blocks: list[list[str]] = []  # equal, deleted, inserted: an equal stretch and the change behind it
    for op, text in raw:
        if op == 0:
            if blocks and not blocks[-1][1] and not blocks[-1][2]:
                blocks[-1][0] += text
            else:
                blocks.append([text, "", ""])
        else:
            if not blocks:
                blocks.append(["", "", ""])
            blocks[-1][1 if op < 0 else 2] += text
    out: list[list[str]] = []
    size = lambda c: max(len(c[1]), len(c[2]))
    for block in blocks:
        out.append(block)
        while len(out) > 1 and size(out[-1]) and len(out[-1][0]) <= min(size(out[-2]), size(out[-1])):
            same, gone, new = out.pop()
            out[-1][1] += same + gone
            out[-1][2] += same + new
    return [(op, text) for same, gone, new in out for op, text in ((0, same), (-1, gone), (1, new)) if text]


def segments(pairs: DataFrame) -> DataFrame:
    """(pair_id, seg, a, b) of (pair_id, word, pdf): stretches of both normalised texts that begin with a line that either
    side has once and that no other such line crosses; the first begins with the text. One shuffle, by pair."""
    side = lambda name: F.transform(F.split(T.diff_normalise(F.coalesce(name, F.lit(""))), "\n", -1), lambda x: x)
    both = pairs.select("pair_id", side("word").alias("word"), side("pdf").alias("pdf")).repartition("pair_id")
    rows = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("lines")) for s in ("word", "pdf")))
    lines = both.select("pair_id", F.inline(rows)).select("pair_id", "side", F.size("lines").alias("many"), F.posexplode("lines").alias("n", "line"))
    lines = lines.withColumn("piece", F.when(F.col("n") + 1 < F.col("many"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")))
    same, order = Window.partitionBy("pair_id", "piece"), Window.partitionBy("pair_id", "side").orderBy("n")
    on = lambda s, f: f(F.when(F.col("side") == s, F.col("n"))).over(same)
    once = (on("word", F.count) == 1) & (on("pdf", F.count) == 1)
    met = lines.withColumn("other", F.when(once, F.when(F.col("side") == "word", on("pdf", F.max)).otherwise(on("word", F.max))))
    above, below = F.max("other").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.min("other").over(order.rowsBetween(1, Window.unboundedFollowing))
    straight = F.col("other").isNotNull() & (F.coalesce(above, F.lit(-1)) < F.col("other")) & (F.coalesce(below, F.lit(2**31 - 1)) > F.col("other"))
    parted = met.withColumn("straight", straight.cast("int")).withColumn("seg", F.sum("straight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("n", "piece")))), lambda x: x["piece"]), "")
    return parted.groupBy("pair_id", "seg").agg(text("word").alias("a"), text("pdf").alias("b"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair_id, seg, a, b) → (pair_id, seg, ops)."""
    for batch in batches:
        ops = [[{"op": op, "text": text} for op, text in edits(a, b)] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ops, pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())])))], names=["pair_id", "seg", "ops"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair_id, ops) → the changes of each pair with their contexts."""
    names = ["ord", "type", "text", "context_before", "context_after"]
    for batch in batches:
        rows, at_row = {n: [] for n in names}, []
        for k, ops in enumerate(batch.column(1).to_pylist()):
            found = tidy([(o["op"], o["text"]) for o in ops])
            whole, at, n = "".join(t for _, t in found), 0, 0
            for op, text in found:
                if op:
                    values = n, "insert" if op > 0 else "delete", text, whole[max(0, at - CONTEXT) : at], whole[at + len(text) : at + len(text) + CONTEXT]
                    for column, value in zip(names, values):
                        rows[column].append(value)
                    at_row.append(k)
                    n += 1
                at += len(text)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_row, pa.int64())), pa.array(rows["ord"], pa.int32()), *(pa.array(rows[n], pa.string()) for n in names[1:])], names=["pair_id", *names])


def parts(a: str, b: str) -> Iterator[tuple[str, str]]:
    """The segments of a pair of texts as :func:`segments` makes them, in one pass over the lines."""
    left, right = (t.split("\n") for t in (a, b))
    left, right = ([*(x + "\n" for x in lines[:-1]), lines[-1]] for lines in (left, right))
    counts, others = Counter(left), Counter(right)
    place = {x: n for n, x in enumerate(right) if others[x] == 1}
    met = [place.get(x) if counts[x] == 1 else None for x in left]
    # Straight lines: no line before them meets one behind theirs, and the other way about.
    below, least = [0] * len(met), len(right)
    for n in range(len(met) - 1, -1, -1):
        below[n] = least
        least = least if met[n] is None else min(least, met[n])
    x = y = 0
    most = -1
    for n, m in enumerate(met):
        if m is not None:
            if most < m < below[n]:
                if n or m:
                    yield "".join(left[x:n]), "".join(right[y:m])
                x, y = n, m
            most = max(most, m)
    yield "".join(left[x:]), "".join(right[y:])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair_id, a, b) → (pair_id, ops) of pairs that differ, a row at a time."""
    for batch in batches:
        at_row, ops = [], []
        for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if a != b:
                at_row.append(k)
                found = (e for x, y in parts(a, b) for e in ([(0, x)] if x == y else edits(x, y)))
                ops.append([{"op": op, "text": text} for op, text in found])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_row, pa.int64())), pa.array(ops, _OPS)], names=["pair_id", "ops"])


_OPS = pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())]))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair_id, a, b) → the changes of each pair with their contexts."""
    return _told(_differences(batches))


def diff(pairs: DataFrame) -> DataFrame:
    """(pair_id, word, pdf) → (pair_id, ord, type, text, context_before, context_after, risk, category).

    Contexts are CONTEXT characters of the running text in which deleted and inserted pieces stand side by side. A null
    side is empty; pairs without a difference give no rows. Pairs are compared where they lie: no shuffle, and a task
    holds no more than a batch of them.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()
    both = pairs.select("pair_id", *(T.diff_normalise(F.coalesce(c, F.lit(""))).alias(c) for c in ("word", "pdf")))
    found = both.mapInArrow(_changes, f"pair_id {kind}, ord int, type string, text string, context_before string, context_after string")
    return found.withColumn("c", T.classify_diff(F.col("text"))).select("*", "c.risk", "c.category").drop("c")


def sides(pairs: DataFrame) -> DataFrame:
    """(pair_id, seg, op, text): all pieces before they are tidied. Deletions and equals make one text, insertions and
    equals the other."""
    kind = pairs.schema["pair_id"].dataType.simpleString()
    return segments(pairs).mapInArrow(_edited, f"pair_id {kind}, seg bigint, ops array<struct<op:int,text:string>>").select("pair_id", "seg", F.posexplode("ops").alias("ord", "o")).select("pair_id", "seg", "ord", "o.op", "o.text")


def line_summary(both: DataFrame) -> DataFrame:
    """AGG-03 on lines: (pair_id, total, insertions, deletions, has_risk) of pairs (pair_id, word, pdf) with lines that only
    one side has, each counted once. A pair's texts lie in one row: no shuffle. A side that is null has no lines."""
    lines = lambda c: F.coalesce(F.split(c, "\n", -1), F.array().cast("array<string>"))
    split = both.select("pair_id", lines("word").alias("w"), lines("pdf").alias("p"))
    lone = split.select("pair_id", F.array_except("p", "w").alias("new"), F.array_except("w", "p").alias("gone"))
    n = lambda c: F.size(c).cast("bigint")
    risky = lambda c: F.exists(c, lambda x: T.classify_diff(x)["risk"] == "high")
    found = F.struct((n("new") + n("gone")).alias("total"), n("new").alias("insertions"), n("gone").alias("deletions"), (risky("new") | risky("gone")).alias("has_risk"))
    # Pairs alike give no row of the generator; a filter would be pushed below what makes the texts, and that done twice.
    return lone.select("pair_id", F.inline(F.filter(F.array(found), lambda x: x["total"] > 0)))


def summary(ops: DataFrame) -> DataFrame:
    """AGG-03."""
    return ops.groupBy("pair_id").agg(F.count("*").alias("total_changes"), F.count_if(F.col("type") == "insert").alias("insertions"), F.count_if(F.col("type") == "delete").alias("deletions"), F.bool_or(F.col("risk") == "high").alias("has_risk"))

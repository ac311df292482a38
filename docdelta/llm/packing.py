"""Operator 2: packing tokenised documents into fixed-length sequences.

The plan works on a histogram of piece lengths, which has as many entries as the capacity whatever the corpus
size: best-fit-decreasing makes classes of equal bins, then the local search moves and exchanges documents (one for
one, two for one, one for two) between underfull bins of two classes, for as many bins at once as both have, while that
raises the sum of squared fills. It ends when no two bins can be improved or the bins are as few as all ids need.
Pieces then find their place by their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import itertools
import logging
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BpeModel, encoder_of
from .storage import materialise

LOG = logging.getLogger(__name__)
PIECES = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Texts above this go to the slower encoder, whose memory does not depend on the regular expression's depth.
RUN_CHARS = 200_000
#: Pieces that are searched at once; counts of more are divided by a factor, and the plan is repeated.
SEARCHED = 50_000


class FastIds:
    """Ids of a byte-level file by its ranks; special strings and extreme texts go their own way."""

    def __init__(self, model: BpeModel):
        self.exact = encoder_of(model)
        ranks = {raw: i for i, raw in enumerate(model.raw) if raw and i not in model.specials.values()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if model.ranked and model.kind == "spaced" else None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > RUN_CHARS or self.ranks is None or self.exact.has_special(text) or self.exact.is_unsure(text):
            return self.exact.encode(text)
        return self.ranks.encode_to_numpy(text, disallowed_special=())


_FAST: dict[str, FastIds] = {}


def fast_ids(model: BpeModel) -> FastIds:
    if model.source not in _FAST:
        _FAST[model.source] = FastIds(model)
    return _FAST[model.source]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """A row for each piece of each document's ids followed by ``end_id``. Documents of up to ``capacity`` ids are
    one piece; longer ones are cut so that only the first piece can be shorter than ``capacity``."""
    tables = docs.sparkSession.sparkContext.broadcast(BpeModel(tokenizer))  # some 60 MB, which the driver does not keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = fast_ids(tables.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                out: list[list] = [[], [], [], [], []]
                for row, text in enumerate(some.column(1).to_pylist()):
                    ids = np.append(ids_of(text or ""), end_id).astype("<u4")
                    data, n = memoryview(ids.tobytes()), len(ids)
                    first = n % capacity or capacity
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        length = capacity if piece else first
                        for column, value in zip(out, (row, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]))):
                            column.append(value)
                numbers = [pa.array(v, k) for v, k in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(out[0], pa.int64())), *numbers], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, PIECES.format(source.schema["doc_id"].dataType.simpleString()))


class _Offers:
    """What underfull bins can give: by the length of a piece or of two pieces, the classes that hold them, emptiest first."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by_length: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def add(self, length: int, contents: tuple[int, ...]) -> None:
        if length not in self.by_length:
            bisect.insort(self.lengths, length)
            self.by_length[length] = []
        bisect.insort(self.by_length[length], (sum(contents), contents))

    def remove(self, length: int, contents: tuple[int, ...]) -> None:
        held = self.by_length[length]
        held.pop(bisect.bisect_left(held, (sum(contents), contents)))
        if not held:
            del self.by_length[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


class Bins:
    """Classes of equal bins: contents (lengths, descending) → how many bins. ``changes`` counts what the search did to
    how many pairs of bins, and the bins it emptied."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: Counter[tuple[int, ...]] = Counter()
        self.changes: Counter[str] = Counter()

    def best_fit(self, histogram: dict[int, int]) -> None:
        """Best-fit-decreasing, for all pieces of a length at once."""
        cap = self.capacity
        by_room: dict[int, list[list]] = defaultdict(list)  # room → [contents, bins]
        rooms: list[int] = []

        def put(contents: tuple[int, ...], bins: int, room: int) -> None:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append([contents, bins])

        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    each = cap // length
                    full, rest = divmod(left, each)
                    if full:
                        put((length,) * each, full, cap - each * length)
                    if rest:
                        put((length,) * rest, 1, cap - rest * length)
                    break
                room = rooms[at]
                contents, bins = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
                each = min(room // length, left)
                some = min(bins, left // each)
                if bins > some:
                    put(contents, bins - some, room)
                put(contents + (length,) * each, some, room - each * length)
                left -= some * each
        for groups in by_room.values():
            for contents, bins in groups:
                self.count[contents] += bins

    def search(self) -> int:
        """Local search; returns the number of bins emptied. Each change raises the sum of squared fills, so it ends."""
        self.ones, self.twos = _Offers(), _Offers()
        for contents in self.count:
            self._offer(contents, _Offers.add)
        left = sum(self.count.values())
        least = -(-sum(sum(c) * n for c, n in self.count.items()) // self.capacity)
        while left > least:
            waiting = sorted((c for c in self.count if sum(c) < self.capacity), key=lambda c: (sum(c), c))
            before = sum(self.changes.values())
            while waiting and left > least:
                taker = waiting.pop()  # the fullest
                while left > least and self.count[taker] and (found := self._better(taker)):
                    _, giver, give, back = found
                    bins = self.count[giver] // 2 if giver == taker else min(self.count[giver], self.count[taker])
                    made = self._exchange(taker, giver, give, back, bins)
                    self.changes["moves" if not back else f"{len(give)} for {len(back)}"] += bins
                    if not all(made):
                        self.changes["emptied"] += bins
                        left -= bins
                    waiting += [c for c in made if 0 < sum(c) < self.capacity]
                if not self.count[taker]:
                    del self.count[taker]
            if sum(self.changes.values()) == before:
                break
        return self.changes["emptied"]

    def _offer(self, contents: tuple[int, ...], put: Callable) -> None:
        """Put a class of underfull bins into the offers, or take it out."""
        if contents and sum(contents) < self.capacity:
            for x in set(contents):
                put(self.ones, x, contents)
            for x in {x + y for x, y in _pairs(contents)}:
                put(self.twos, x, contents)

    def _exchange(self, taker: tuple, giver: tuple, give: tuple, back: tuple, bins: int) -> list[tuple[int, ...]]:
        after = []
        for old, out, into in ((giver, give, back), (taker, back, give)):
            new = list(old)
            for x in out:
                new.remove(x)
            after.append(tuple(sorted((*new, *into), reverse=True)))
        for change, classes in ((-bins, (giver, taker)), (bins, after)):
            for c in classes:
                had = self.count[c]
                self.count[c] = had + change
                if c and bool(had) != bool(self.count[c]):
                    self._offer(c, _Offers.add if change > 0 else _Offers.remove)
        del self.count[()]
        if not self.count[giver]:
            del self.count[giver]
        return after

    def _better(self, taker: tuple[int, ...]) -> tuple[int, tuple, tuple, tuple] | None:
        """(gain, giver, what it gives, what it gets back) of the change that fills ``taker`` most: moves before exchanges."""
        room, best = self.capacity - sum(taker), None
        singles, doubles = [(y,) for y in sorted(set(taker))], sorted(_pairs(taker), key=sum)
        for offers, backs in ((self.ones, [()]), (self.ones, singles), (self.twos, singles), (self.ones, doubles)):
            for back in backs:
                if best and best[0] == room:
                    return best
                found = self._offered(offers, taker, sum(back), room, best[0] if best else 0)
                if found:
                    gain, giver, length = found
                    best = gain, giver, (length,) if offers is self.ones else next(p for p in _pairs(giver) if sum(p) == length), back
        return best

    def _offered(self, offers: _Offers, taker: tuple[int, ...], back: int, room: int, beyond: int) -> tuple[int, tuple, int] | None:
        """(gain, giver, length) of the largest length that fits in exchange for ``back`` and gains more than ``beyond``.
        What a fuller bin gives must outweigh the difference, for the squares to grow."""
        at = bisect.bisect_right(offers.lengths, back + room)
        while at and (gain := offers.lengths[at - 1] - back) > beyond:
            at -= 1
            for total, giver in itertools.islice(offers.by_length[offers.lengths[at]], 2):
                if (giver != taker or self.count[taker] > 1) and gain > total - sum(taker):
                    return gain, giver, offers.lengths[at]
        return None


def _pairs(contents: tuple[int, ...]) -> set[tuple[int, int]]:
    """The different pairs of lengths in a bin; its different lengths are few, since they add up to the capacity."""
    once = sorted(set(contents))
    return {*itertools.combinations(once, 2), *((x, x) for x, n in Counter(contents).items() if n > 1)}


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(contents, bins) of each class of bins for these counts of lengths.

    Counts of more than SEARCHED pieces are divided by a factor before the search and its bins multiplied after it; what
    is left over is planned likewise, so the time does not grow with the pieces. Of that and best fit on all counts the
    better one counts.
    """
    whole = Bins(capacity)
    whole.best_fit(histogram)
    before, least = sum(whole.count.values()), -(-sum(k * n for k, n in histogram.items()) // capacity)
    if before > least:
        found = _searched(histogram, capacity)
        if sum(found.count.values()) < before:
            whole = found
    LOG.info("%d bins by best fit, %d after the search (at least %d): %s", before, sum(whole.count.values()), least, dict(whole.changes))
    return sorted(whole.count.items(), reverse=True)


def _searched(histogram: dict[int, int], capacity: int) -> Bins:
    out, left = Bins(capacity), {k: n for k, n in histogram.items() if n}
    while left:
        factor = max(1, sum(left.values()) // SEARCHED)
        part = Bins(capacity)
        part.best_fit({k: n // factor for k, n in left.items() if n >= factor})
        part.search()
        for contents, bins in part.count.items():
            out.count[contents] += bins * factor
        for change, bins in part.changes.items():
            out.changes[change] += bins * factor
        left = {k: n % factor for k, n in left.items() if n % factor}
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pack every piece of every document into sequences of at most ``capacity`` ids.

    Returns the columns of :data:`PIECES` with ``sequence_id`` and ``offset``; other columns, whatever their names, are
    left out, and ids may be of any orderable type. A null text is an empty document (one id); a null id stays null;
    repeated rows are packed each; an empty table gives no rows. Whole texts are encoded, once, very long ones in
    slices; what follows sees a few numbers for each piece. Ties between equal lengths fall by id, piece, checksum.
    Ranks among equal lengths are counted in two steps over ranges of the sorted pieces, so that a length that
    holds many rows is no single task. The driver gets one count for each length.
    """
    spark = docs.sparkSession
    pieces, _ = materialise(cut_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col, end_id=end_id), "pieces")
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # length → (first rank, bins, first sequence, offset)
    taken: Counter[int] = Counter()
    sequence = 0
    for contents, bins in plan_bins(counted, capacity):
        offset = 0
        for length in contents:
            slots[length].append((taken[length], bins, sequence, offset))
            taken[length] += bins
            offset += length
        sequence += bins
    plan = {length: tuple(np.array(v, np.int64) for v in zip(*rows)) for length, rows in slots.items()}
    shared = spark.sparkContext.broadcast(plan)

    ranked, _ = materialise(
        pieces.repartitionByRange(F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")).withColumn("part", F.spark_partition_id()), "ranges"
    )
    before = (
        ranked.groupBy("part", "length").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    )
    local = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    placed = ranked.withColumn("rank", F.row_number().over(local) - 1).join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            where, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                first, _, sequence, shift = plan[int(one)]
                rows = np.flatnonzero(length == one)
                at = np.searchsorted(first, rank[rows], "right") - 1
                where[rows], offset[rows] = sequence[at] + rank[rows] - first[at], shift[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(place, PIECES.format(kind) + ", sequence_id bigint, offset bigint")

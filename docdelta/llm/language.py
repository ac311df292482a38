"""Operator 10: language identification by compression.

Each language has a raw-content zstandard dictionary of labelled texts; a text has the language whose dictionary
compresses it smallest. Narrow margins are rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import column

#: The bound of the labelled sample: texts of each language (those with the smallest hash of id and text) and characters
#: of each used in a dictionary. Every language of the labels is learned.
SAMPLE_TEXTS, SAMPLE_CHARS = 40, 3_000
LEVEL = 6
#: Bytes compressed at a time. A longer text goes in pieces, each against the dictionary alone: within one run a text
#: soon compresses against itself, and the margin would shrink with its length.
PIECE = 8_192
#: Bytes a text's margin must reach for acceptance, as a share of the larger size.
MARGIN = 0.003
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Dictionaries:
    """Raw content by language, the frequent material last, where it is nearest to a text."""

    content: dict[str, bytes]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, data in sorted(self.content.items()):
            made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Dictionaries:
    """Dictionaries from a bounded sample of the rows with a language and a text.

    The sample is the SAMPLE_TEXTS rows of each language with the smallest hashes, found over languages and hashes
    alone; the driver gets their beginnings, SAMPLE_CHARS each. Rows without letters teach nothing, repeated rows as
    much as one. No labelled row: no language.
    """
    lang, text = column(lang_col).cast("string"), column(text_col).cast("string")
    rows = labelled.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(column(id_col).cast("string"), text).alias("h")).where("rlike(text, '\\\\p{L}')")
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").withColumn("place", place).where(F.col("place") <= SAMPLE_TEXTS).select("lang", "h").distinct()
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).distinct()  # SAMPLE_TEXTS rows a language
    got: dict[str, list[tuple[int, str]]] = {}
    for r in texts.collect():
        got.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return Dictionaries({lang: b" ".join(letters(t) for _, t in sorted(some)) for lang, some in got.items()})


def letters(text: str) -> bytes:
    """What is compressed: the words of letters in lower case. Case, digits and signs say little about a language."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def pieces(data: bytes) -> list[bytes]:
    """The data in pieces of about PIECE bytes, cut before words where there are any; none is much shorter than the others."""
    n, out, at = max(round(len(data) / PIECE), 1), [], 0
    for k in range(1, n):
        target = len(data) * k // n
        cut = data.rfind(b" ", max(at, target - 256), target) if target > at else -1
        if cut < 0:  # no word begins nearby: between two characters
            cut = target
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def judge(text: str, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """(language, score, margin) of a text with letters. Ties go to the first language by name.

    Each piece is compressed alone and twice over: in a short text single bytes decide little, and the second sum often
    parts languages that tie in the first.
    """
    parts = [d for p in pieces(letters(text)) for d in (p, p + b" " + p)]
    sizes = [(sum(len(c.compress(d)) for d in parts), lang) for lang, c in compressors]
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    rest = sum(math.exp(-60 * (s - sizes[0][0]) / s) for s, _ in sizes[1:])
    return sizes[0][1], 1 / (1 + rest), margin


def identify(docs: DataFrame, dictionaries: Dictionaries, *, text_col: str = "text", margin: float = MARGIN, keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """(the columns of ``keep``, lang_pred, score, accepted) for every row, from the text alone. ``names`` renames the
    three, for tables that have such columns; other columns, whatever their names, are left out.

    A null text or one without letters is ``und`` with score 0 and not accepted, and so is any text if no language
    was learned. Others get a learned language; ``accepted`` is false when the margin is narrower than ``margin``.
    Whole texts are compressed in pieces, once a language. No shuffle; the dictionaries' size is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = [f"c{k}" for k in range(len(keep))]
    source = docs.select(*(column(c).alias(k) for c, k in zip(keep, kept)))
    place = keep.index(text_col) if text_col in keep and source.schema[keep.index(text_col)].dataType.simpleString() == "string" else len(keep)
    if place == len(keep):
        source = docs.select(*(column(c).alias(k) for c, k in zip(keep, kept)), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                langs, scores, accepted = [], [], []
                for text in some.column(place).to_pylist():
                    if text is None or not compressors or not any(map(str.isalpha, text)):
                        found = UNKNOWN, 0.0, -1.0
                    else:
                        found = judge(text, compressors)
                    langs.append(found[0])
                    scores.append(found[1])
                    accepted.append(found[2] >= margin)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[*kept, "lang", "score", "accepted"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[: len(kept)]]
    found = source.mapInArrow(run, ", ".join([*fields, "lang string, score double, accepted boolean"]))
    return found.select(*(F.col(k).alias(n) for k, n in zip([*kept, "lang", "score", "accepted"], [*keep, *names])))


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text is divisible by 5. A null id is in neither fold's labels and not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))

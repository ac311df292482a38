"""Operator 9: token counts of fields and sections from one encoding of the whole document.

Rule for tokens that cross a boundary: a token belongs to the section that holds its first character. A line break
belongs to the section that it ends, a separator between fields to the field before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BpeModel
from .packing import fast_ids

SCHEMA = "field string, section int, start bigint, `end` bigint, n_tokens bigint, n_crossing bigint"


def token_starts(ids: np.ndarray, sizes: np.ndarray, text: bytes) -> np.ndarray:
    """The character at which each token starts, for byte-level tokens whose bytes follow on in ``text``."""
    ends = np.cumsum(sizes[ids])
    first = ends - sizes[ids]
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.cumsum(leads)[first] - 1


def attribute_tokens(docs: DataFrame, tokenizer: str, *, fields: Sequence[str] = ("text",), id_col: str = "doc_id", separator: str = "\n\n", newline: str = "\n") -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, n_crossing): a row for each line of each field of each row.

    The fields, joined by ``separator``, are encoded once; ``start`` and ``end`` are character positions in the
    joined text, ``end`` exclusive and without the line break. ``n_crossing`` counts the section's tokens that reach
    into a later one. Counts over a document add up to its tokens. A null field is empty and has one empty section;
    null ids stay null; repeated rows are counted each; columns besides the id and the fields, whatever their names,
    are left out. No shuffle; memory is bounded by a batch of texts. Only for byte-level vocabularies.
    """
    model = BpeModel(tokenizer)
    if model.kind != "spaced":
        raise ValueError("offsets need a tokenizer that keeps the text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary
    source = docs.select(docs[id_col].alias("doc_id"), *(docs[f].cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids_of, sizes = fast_ids(model), np.array([len(b) for b in model.raw], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                rows, field, section, begin, end, tokens, crossing = [], [], [], [], [], [], []
                for row, values in enumerate(zip(*(some.column(1 + k).to_pylist() for k in range(len(names))))):
                    values = [v or "" for v in values]
                    text = separator.join(values)
                    data = text.encode("utf-8", "surrogatepass")
                    starts, stops, owner, number, base = [], [], [], [], 0
                    for name, value in zip(names, values):
                        for k, line in enumerate(value.split(newline)):
                            starts.append(base)
                            stops.append(base + len(line))
                            owner.append(name)
                            number.append(k)
                            base += len(line) + len(newline)
                        base += len(separator) - len(newline)
                    ids = ids_of(text)
                    first = token_starts(ids, sizes, data) if len(ids) else np.zeros(0, np.int64)
                    bounds = np.array(starts, np.int64)
                    own = np.searchsorted(bounds, first, "right") - 1
                    counts = np.bincount(own, minlength=len(bounds))
                    last = np.append(first[1:], len(text)) - 1 if len(first) else first  # a token's last character, or the one it shares
                    over = np.bincount(own[np.searchsorted(bounds, np.maximum(last, first), "right") - 1 > own], minlength=len(bounds))
                    rows += [row] * len(bounds)
                    for column, found in zip((field, section, begin, end, tokens, crossing), (owner, number, starts, stops, counts.tolist(), over.tolist())):
                        column += found
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows, pa.int64())), pa.array(field, pa.string()), pa.array(section, pa.int32()), *(pa.array(v, pa.int64()) for v in (begin, end, tokens, crossing))],
                    names=["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")

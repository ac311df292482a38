"""Operator 1: BPE encoding and decoding of whole texts (see :mod:`docdelta.llm.bpe` for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BpeModel, encoder_of


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode each text, decode the ids again, and return a row for every input row.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded text in UTF-8); with ``ids=True`` also ``ids`` and ``decoded``.
    A null text counts as empty, a null id stays null, repeated rows are encoded each; other columns, whatever
    their names, are left out. No shuffle: an Arrow map over two columns; a text is encoded in bounded slices.
    """
    tables = docs.sparkSession.sparkContext.broadcast(BpeModel(tokenizer))  # bounded by the vocabulary
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                counts, first, second, rows, texts = [], [], [], [], []
                for found in encoder.encode_all(some.column(1).to_pylist()):
                    decoded = encoder.decode(found)
                    counts.append(len(found))
                    first.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if ids:
                        rows.append(found.astype("i8"))
                        texts.append(decoded)
                columns = [some.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                columns += [pa.array(rows, pa.list_(pa.int64())), pa.array(texts, pa.string())] if ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return source.mapInArrow(run, schema)

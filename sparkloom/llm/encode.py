"""Encoding of a whole corpus with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import TOKENIZER, groups, shipped, store


def _encoder(tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001 - a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids, n = own.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode_texts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without special tokens.

    A null or empty text gives an empty list; a blank one the ids of its spaces. The
    strings of special tokens count as ordinary text. Each distinct piece is encoded
    once in a worker: pieces of equal length form one matrix in which every row joins
    its leftmost pair of least rank each round. No shuffle; repeated rows are kept.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(shipped(documents, tokenizer)), "doc_id long, ids array<int>")


def _decoder(tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001 - a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = store(tokenizer).merges
        for batch in batches:
            texts = [None if ids is None else merges.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_texts(encoded: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of lists of ids; an empty list gives an empty text, null gives null."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decoder(shipped(encoded, tokenizer)), "doc_id long, text string")

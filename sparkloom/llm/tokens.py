"""Tokenizer files and token counts by record, shared by the operators that measure length."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import message_rows
from sparkloom.llm.bpe import Pieces

#: Where the public tokenizers lie, unless a path is given.
TOKENIZER = os.path.join(os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Texts encoded together are cut where they exceed so many characters.
CHARACTERS = 4_000_000

#: Largest tokenizer file that is sent to the executors.
MOST_BYTES = 64_000_000

_stores: dict[str, Pieces] = {}


def shipped(df: DataFrame, path: str):  # noqa: ANN201 - a broadcast
    """(digest, bytes) of a tokenizer file of the driver, for its executors: they need no copy of it. Raises ``ValueError`` above MOST_BYTES."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def store(tokenizer) -> Pieces:  # noqa: ANN001 - a broadcast of shipped()
    """The known pieces of a tokenizer, kept while the Python worker lives."""
    digest, data = tokenizer.value
    if digest not in _stores:
        _stores[digest] = Pieces(data)
    return _stores[digest]


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of at most CHARACTERS together, or of one longer text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > CHARACTERS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def counts(own: Pieces, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text."""
    parts = [own.encode(texts[a:b])[1] for a, b in groups(texts)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _message_counter(tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(tokenizer)
        for batch in batches:
            rows = [m or () for m in message_rows(batch)]
            by_message = counts(own, [content for m in rows for _, content in m])
            ends = np.concatenate(([0], np.cumsum(by_message)))[np.concatenate(([0], np.cumsum([len(m) for m in rows]))).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64))], names=["record_id", "n_tokens"])

    return run


def record_tokens(records: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "record_id", messages_col: str = "messages") -> DataFrame:
    """(record_id, n_tokens): tokens of all message contents together, without special tokens; null or empty messages and contents count 0."""
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), F.col(messages_col).alias("messages"))
    return rows.mapInArrow(_message_counter(shipped(records, tokenizer)), "record_id long, n_tokens long")


def _text_counter(tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(tokenizer)
        for batch in batches:
            n = counts(own, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64))], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def text_tokens(rows: DataFrame, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each text; null and empty texts count 0."""
    picked = rows.select(*keep, F.col(text_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_text_counter(shipped(rows, tokenizer)), kinds + ", n_tokens long")

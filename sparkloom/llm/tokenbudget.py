"""Token budget: how many tokens each source, language and task holds under a public tokenizer.

The text is split into pieces once; each task counts its pieces by slice before
anything is shuffled, and the counts of all tasks meet by slice and piece. Distinct pieces
with their counts are then dealt by piece, so a piece's symbols are merged in one place,
however often it occurs in the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import message_rows
from sparkloom.llm.bpe import split
from sparkloom.llm.canonical import role_of
from sparkloom.llm.lang import LANGUAGES, language_counts
from sparkloom.functions.text import normal_name
from sparkloom.llm.tokens import TOKENIZER, shipped, store

#: Distinct (slice, piece) counts a task holds before it passes them on; bounds memory, changes no result.
HELD = 500_000

_COUNTS = pa.schema([("source", pa.string()), ("lang", pa.string()), ("task", pa.string()), ("piece", pa.string()), ("n", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (source, lang, task), pieces in held.items():
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * n), pa.array([lang] * n), pa.array([task] * n), pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], schema=_COUNTS
            )
        held.clear()

    for batch in batches:
        for source, task, messages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), message_rows(batch)):
            words: Counter = Counter()
            for role, content in messages or ():
                if content and role_of(role) != "system":
                    words.update(language_counts(content))
            lang = max(LANGUAGES, key=lambda k: words.get(k, 0)) if words else "und"
            mine = held.setdefault((source, lang, task), Counter())
            mine[None] += 1  # the records of the slice
            for _, content in messages or ():
                if content:
                    mine.update(split(content))
        if sum(map(len, held.values())) > HELD:
            yield from out()
    yield from out()


def _weigher(tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001 - a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = store(tokenizer).merges
        for batch in batches:
            pieces = batch.column(3).to_pylist()
            distinct = {p: i for i, p in enumerate(dict.fromkeys(p for p in pieces if p is not None))}
            lengths = np.array([len(x) for x in merges.encode([p.encode("utf-8", "replace") for p in distinct])] or [0], np.int64)
            where = np.array([-1 if p is None else distinct[p] for p in pieces], np.int64)
            n = np.asarray(batch.column(4))
            tokens = np.where(where < 0, 0, lengths[where] * n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.where(where < 0, n, 0)), pa.array(tokens)], names=["source", "lang", "task", "records", "tokens"])

    return run


def token_budget(records: DataFrame, tokenizer: str = TOKENIZER, messages_col: str = "messages", source_col: str = "source", task_col: str = "task") -> DataFrame:
    """(source, lang, task, records, tokens), one row per slice, over all messages of all records.

    Spelling variants of source and task are brought together, null and blank ones
    become 'unknown'. ``lang`` is the language of the record's messages but the system
    ones ('und' where nothing tells). Null or empty messages and contents add a record
    of 0 tokens. Repeated records count again.
    """
    rows = records.select(normal_name(F.col(source_col)).alias("source"), normal_name(F.col(task_col)).alias("task"), F.col(messages_col).alias("messages"))
    counted = rows.mapInArrow(_count_batches, "source string, lang string, task string, piece string, n long")
    # Counts meet by slice and piece first, so that a piece as frequent as " the" comes to the task that merges it once per slice. Counts of a slice's records have no piece: they are spread by slice.
    pieces = counted.groupBy("source", "lang", "task", "piece").agg(F.sum("n").alias("n")).repartition("piece", F.when(F.col("piece").isNull(), F.hash("source", "lang", "task")))
    weighed = pieces.mapInArrow(_weigher(shipped(records, tokenizer)), "source string, lang string, task string, records long, tokens long")
    return weighed.groupBy("source", "lang", "task").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))

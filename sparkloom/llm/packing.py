"""Filling sequences of fixed capacity with records, as little space unused as possible.

Sum-of-squares packing, online: each record goes to the fill level that leaves the
least sum of squared counts of partly filled sequences; the counts are a level array.
The records are dealt by hash into shards of bounded size that are packed by
themselves, so the work is spread and a shard's open sequences are a small part of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.tokens import TOKENIZER, record_tokens
from sparkloom.plans.durable import durable

#: Records of a shard, on average.
SHARD_ROWS = 25_000

_PLACED = "stage string, capacity int, seq_id long, record_id long, part int, seq_offset int, n_tokens int"
_ROWS = pa.schema([("stage", pa.string()), ("capacity", pa.int32()), ("seq_id", pa.int64()), ("record_id", pa.int64()), ("part", pa.int32()), ("seq_offset", pa.int32()), ("n_tokens", pa.int32())])


class Packer:
    """Sum-of-squares packing of one shard."""

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("a sequence holds one token at least")
        self.capacity, self.made = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)  # sequences filled to each level; 0 and the full ones stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for an item of 0 to ``capacity`` tokens."""
        capacity, level = self.capacity, self.level
        if size == 0:
            self.made = max(self.made, 1)
            return 0, 0
        # Change of the sum of squares, halved: at a level h > 0, level[h + size] - level[h] + 1, where a full sequence counts nothing.
        change = level[size:] - level[: capacity - size + 1] + 1
        change[capacity - size] -= 1 + level[capacity]
        change[level[: capacity - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = level[size] + 1 if size < capacity else 0  # a new sequence
        at = int(len(change) - 1 - change[::-1].argmin())  # the fullest of equals
        if at:
            number = self.open[at].pop()
            level[at] -= 1
        else:
            number = self.made
            self.made += 1
        if at + size < capacity:
            self.open[at + size].append(number)
            level[at + size] += 1
        return number, at


def _packer(limits: list[tuple[str | None, int]], shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, limit = (k.as_py() for k in key)
        stage, capacity = limits[limit]
        packer, out = Packer(capacity), [[], [], [], [], []]
        order = sorted(zip(rows.column("order").to_pylist(), rows.column("record_id").to_pylist(), rows.column("n_tokens").to_pylist()), key=lambda r: (r[0], r[1] is None, r[1], r[2]))
        first = (limit * shards + shard) << 32
        for _, record_id, n in order:
            for part in range(max(1, -(-n // capacity))):
                size = min(capacity, n - part * capacity)
                number, offset = packer.place(size)
                for column, value in zip(out, (first + number, record_id, part, offset, size)):
                    column.append(value)
        n = len(out[0])
        return pa.table([pa.array([stage] * n, pa.string()), pa.array([capacity] * n, pa.int32()), *(pa.array(c, f.type) for c, f in zip(out, list(_ROWS)[2:]))], schema=_ROWS)

    return run


def pack_lengths(lengths: DataFrame, limits: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Assign every (record_id, n_tokens) of ``lengths`` to sequences, for each (stage, max_seq_length) of ``limits``.

    One row per record and limit: stage, capacity, seq_id, record_id, part, seq_offset, n_tokens.
    ``seq_id`` is unique over all limits.
    A record longer than a sequence fills whole ones of its own, and its rest (the last
    part) is packed like any record; no other record is split. A record without tokens
    goes to the start of its shard's first sequence. Stages whose limit is null or below
    1 are left out, a stage given twice counts once per distinct limit; a null stage is
    kept as one. Null ids are kept.
    Empty tables give no rows.
    """
    shards = max(1, -(-lengths.count() // shard_rows))
    # A limit table is a list of training stages: its size is checked before the packer holds it.
    chosen = limits.where("max_seq_length >= 1").select("stage", F.col("max_seq_length").cast("int").alias("capacity")).distinct().limit(1001).collect()
    if len(chosen) > 1000:
        raise ValueError("more than 1000 stages")
    if not chosen:
        return lengths.sparkSession.createDataFrame([], _PLACED)
    chosen = sorted(((r.stage, r.capacity) for r in chosen), key=lambda r: (r[0] is None, r[0], r[1]))
    order = F.xxhash64("record_id", "n_tokens")
    each = F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("limit")
    dealt = lengths.select("record_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard"), each)
    return dealt.groupBy("shard", "limit").applyInArrow(_packer(chosen, shards), _PLACED)


def pack_records(records: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """:func:`pack_lengths` of records as long as all their messages together."""
    return pack_lengths(durable(record_tokens(records, tokenizer), "lengths"), limits, shard_rows)


def packing_report(placed: DataFrame) -> DataFrame:
    """(stage, capacity, sequences, tokens, fill): how full the sequences of each limit are; a null stage is one. Empty tables give no rows."""
    used = placed.groupBy("stage", "capacity", "seq_id").agg(F.sum("n_tokens").alias("tokens")).groupBy("stage", "capacity").agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"))
    return used.select("stage", "capacity", "sequences", "tokens", (F.col("tokens") / (F.col("sequences") * F.col("capacity"))).alias("fill"))


def packing_invariants(placed: DataFrame) -> DataFrame:
    """(stage, capacity, records, overfull, overlapping, split): records placed; sequences with more tokens than they hold; pieces that begin before the one before them ends; records split although they fit. The last three are 0 in a packing that keeps the rules."""
    before = F.coalesce(F.max(F.col("seq_offset") + F.col("n_tokens")).over(Window.partitionBy("seq_id").orderBy("seq_offset", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = placed.withColumn("clash", ((F.col("seq_offset") < before) & (F.col("n_tokens") > 0)).cast("int"))
    sequences = own.groupBy("stage", "capacity", "seq_id").agg(F.sum("n_tokens").alias("tokens"), F.sum("clash").alias("clashes"))
    by_limit = sequences.groupBy("stage", "capacity").agg(F.count(F.when(F.col("tokens") > F.col("capacity"), 1)).alias("overfull"), F.sum("clashes").alias("overlapping"))
    records = placed.groupBy("stage", "capacity", "record_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    counted = records.groupBy("stage", "capacity").agg(F.count(F.lit(1)).alias("records"), F.count(F.when((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity")), 1)).alias("split"))
    same = by_limit["stage"].eqNullSafe(counted["stage"]) & (by_limit["capacity"] == counted["capacity"])
    return by_limit.join(counted, same).select(by_limit["stage"], by_limit["capacity"], "records", "overfull", "overlapping", "split")

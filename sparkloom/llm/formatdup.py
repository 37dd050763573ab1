"""Copies hidden by formatting: the same letters and digits under other case, spacing, punctuation or field order.

Every record becomes two 128-bit hashes with 64-bit check values in one pass over the
text; only these 60 bytes a record are shuffled. They are counted with map-side
combining first: what follows works on distinct forms, however often each was delivered.
A key that occurs with two check values is a collision; the check value is part of every
key, so colliding records stay apart, and the number is reported. Ids of copies come
back through a join of the forms that have any; forms with many records are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import message_rows
from sparkloom.llm.canonical import canonical_letters, role_of
from sparkloom.plans.durable import durable

#: Records of one form that meet in one task when ids come back; and forms treated so, at most: their list is broadcast.
PART_ROWS, MOST_HOT = 100_000, 1_000

_HASHES = pa.schema([("row_id", pa.int64()), ("plain", pa.binary()), ("plain_check", pa.int64()), ("sorted", pa.binary()), ("check", pa.int64()), ("n_fields", pa.int32())])
FORM = ["plain", "plain_check", "sorted", "check"]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def form_hashes(plain: list[str], ordered: list[str]) -> tuple[bytes, int, bytes, int]:
    """Hash and check value of the messages' letters in order, and with labelled fields sorted."""
    a = "\x1e".join(plain).encode("utf-8", "surrogatepass")
    first = xxhash.xxh3_128_digest(a), _signed(xxhash.xxh64_intdigest(a, 7))
    if plain == ordered:
        return (*first, *first)
    b = "\x1e".join(ordered).encode("utf-8", "surrogatepass")
    return (*first, xxhash.xxh3_128_digest(b), _signed(xxhash.xxh64_intdigest(b, 7)))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for row_id, messages in zip(batch.column(0).to_pylist(), message_rows(batch)):
            if not messages:
                continue
            plain, ordered, with_fields = [], [], 0
            for role, content in messages:
                a, b = canonical_letters(content)
                with_fields += a != b
                head = role_of(role) + "\x1d"
                plain.append(head + a)
                ordered.append(head + b)
            for column, value in zip(out, (row_id, *form_hashes(plain, ordered), with_fields)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _HASHES)], schema=_HASHES)


def canonical_hashes(records: DataFrame, id_col: str = "record_id", messages_col: str = "messages") -> DataFrame:
    """One row per record with messages: row_id, hash and check value of its letters in order and with labelled fields sorted, and how many messages have fields.

    Rows with null or empty ``messages`` are left out; null contents and roles count as
    empty.
    """
    rows = records.select(F.col(id_col).cast("long").alias("row_id"), F.col(messages_col).alias("messages"))
    return durable(rows.mapInArrow(_hash_batches, "row_id long, plain binary, plain_check long, sorted binary, check long, n_fields int"), "formatdup")


def forms_of(hashes: DataFrame, *also: str) -> DataFrame:
    """Distinct forms (and other columns) with their rows, smallest and greatest id, and the key of their group.

    A record that shows fewer labelled fields than another with the same letters (its
    line ends were lost, say) takes the key of that record.
    """
    own = [*FORM, *also]
    forms = hashes.groupBy(*own).agg(F.max("n_fields").alias("n_fields"), F.count(F.lit(1)).alias("n"), F.min("row_id").alias("least"), F.max("row_id").alias("most"))
    best = F.max(F.struct("n_fields", "sorted", "check")).over(Window.partitionBy("plain", "plain_check")).alias("best")
    return forms.select(*own, "n", "least", "most", best).select(*own, "n", "least", "most", F.col("best.sorted").alias("key"), F.col("best.check").alias("key_check"))


def format_groups(hashes: DataFrame) -> DataFrame:
    """One row per distinct record: keep_id (smallest id), copies (rows in the group), collision (its hash has another check value too)."""
    groups = forms_of(hashes).groupBy("key", "key_check").agg(F.min("least").alias("keep_id"), F.sum("n").alias("copies"))
    return groups.select("keep_id", "copies", (F.count(F.lit(1)).over(Window.partitionBy("key")) > 1).alias("collision"))


def format_copies(hashes: DataFrame) -> DataFrame:
    """(keep_id, copy_id) for each record that isn't the smallest id of its group.

    A repeated id counts once. A group of any size is counted map-side; a form with more
    records than PART_ROWS, and than a thousandth of all, is spread over several tasks
    where its ids come back.
    """
    forms = forms_of(hashes)
    groups = forms.groupBy("key", "key_check").agg(F.min("least").alias("keep_id"), F.max("most").alias("last")).where("keep_id < last")
    members = forms.select(*FORM, "n", "key", "key_check").join(groups.select("key", "key_check", "keep_id"), ["key", "key_check"])
    members = durable(members.select(*FORM, "n", "keep_id"), "forms")  # distinct forms of groups with copies
    part_rows = max(PART_ROWS, hashes.count() // MOST_HOT)
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    hot = F.broadcast(members.where(F.col("n") > part_rows).select(*FORM, parts.alias("parts")))  # at most MOST_HOT
    rows = hashes.join(hot, FORM, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("parts")), F.lit(0)).cast("int"))
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select(*FORM, "part", "row_id").join(members.select(*FORM, "part", "keep_id"), [*FORM, "part"]).where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id")).distinct()

"""Dialogue state and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip
from sparkloom.plans.durable import durable

EXIT_WORDS = ("exit", "quit")


def history_prefixes(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each turn with ``history``, the array of all messages of its conversation up to it."""
    upto = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("history", F.collect_list(F.struct("role", "content")).over(upto))


def prefixes_of(messages: Column) -> Column:
    """The same for a whole dialogue in one array: for each place, the messages up to it. No shuffle."""
    return F.transform(F.sequence(F.lit(1), F.size(messages)), lambda k: F.slice(messages, F.lit(1), k))


def user_turns(lines: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Lines of a chat that count: those before the first exit word of their conversation, blank ones skipped."""
    own = F.lower(strip(F.coalesce(F.col(text), F.lit(""))))
    upto = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.when(own.isin(*EXIT_WORDS), 1).otherwise(0)).over(upto)
    return lines.withColumn("_ended", ended).where((F.col("_ended") == 0) & (own != "")).drop("_ended")


def batch_numbers(rows: DataFrame, size: int, order: str = "pos") -> DataFrame:
    """Rows with ``batch``, consecutive chunks of ``size`` by a dense position from 0: no window is needed."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


def dense_position(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Rows with their place (from 0) by ``order``, found by range partitions and their sizes instead of one global window. Equal values of ``order`` stand in any order.

    The partitioned rows are written once: bounds of range partitions come from a sample,
    so rows and counts read apart would not agree on them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = durable(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # one row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return sorted_rows.withColumn("_within", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_within", "_start")

"""Registered queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import encode, formatdup, mixing, packing, pairs, pii, readability, splitoverlap, tokenbudget
from sparkloom.llm.sql import SQL
from sparkloom.plans.durable import durable
from sparkloom.sources.tables import spread, table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and the kinds of personal information in them."""
    return pii.pii_kinds(spread(table(spark, folder, "finetune_data")))


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with typed placeholders."""
    return pii.redact_messages(spread(table(spark, folder, "finetune_data")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies hidden by formatting."""
    return formatdup.format_copies(formatdup.canonical_hashes(spread(table(spark, folder, "finetune_data"))))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records with the number of their copies."""
    return formatdup.format_groups(formatdup.canonical_hashes(spread(table(spark, folder, "finetune_data"))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records and the defects of their answers."""
    return pairs.pair_defects(spread(table(spark, folder, "finetune_data")))


def p4_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Records assigned to sequences of each stage."""
    return packing.pack_records(spread(table(spark, folder, "finetune_data")), table(spark, folder, "seq_limits"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the sequences of each stage are."""
    return packing.packing_report(p4_packed(spark, folder))


def p4_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the packing keeps its rules."""
    return packing.packing_invariants(durable(p4_packed(spark, folder), "packed"))


def p5_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per source, language and task."""
    return tokenbudget.token_budget(spread(table(spark, folder, "finetune_data")))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the token budget per source and task: none is left out, and no text costs nothing."""
    rows = p5_budget(spark, folder).groupBy("source", "task").agg(F.sum("records").alias("records"), (F.sum("tokens") > 0).alias("any_tokens"))
    return rows.select("source", "task", "records", "any_tokens")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of train and evaluation records that are the same or almost."""
    return splitoverlap.split_overlaps(spread(table(spark, folder, "finetune_data")))


def p6_members(spark: SparkSession, folder: str) -> DataFrame:
    """Records with their classes of equal words and the pairs that name them."""
    return splitoverlap.overlap_members(spread(table(spark, folder, "finetune_data")))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    records = spread(table(spark, folder, "finetune_data"))
    return splitoverlap.overlap_report(splitoverlap.split_overlaps(records), records)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return encode.encode_texts(spread(table(spark, folder, "documents")))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the ids of each document give its text back."""
    # Hashes meet, not texts.
    own = table(spark, folder, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("own"))
    back = encode.decode_texts(p7_ids(spark, folder)).select("doc_id", F.md5("text").alias("back"))
    return own.join(back, "doc_id").select("doc_id", (F.col("own") == F.col("back")).alias("same"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents mixed to the target shares."""
    targets = table(spark, folder, "mix_targets")
    return mixing.mixture(mixing.sized_texts(spread(table(spark, folder, "documents")), targets), targets)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares the mixture reaches."""
    targets = table(spark, folder, "mix_targets")
    sized = mixing.sized_texts(spread(table(spark, folder, "documents")), targets)
    return mixing.mixture_shares(mixing.mixture(sized, targets), sized, targets)


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mixture keeps each target's share, to its longest text and its part of the others' longest ones, and its repeats; targets without texts get nothing."""
    targets = table(spark, folder, "mix_targets")
    sized = mixing.sized_texts(spread(table(spark, folder, "documents")), targets)
    shares = mixing.mixture_shares(durable(mixing.mixture(sized, targets), "mixture"), sized, targets)
    rows = shares.join(sized.groupBy("source").agg(F.max("n_tokens").alias("longest")), "source", "left").fillna(0, ["longest"])
    whole = Window.partitionBy(F.lit(1))  # one row a target
    due = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).over(whole)).otherwise(0.0)
    missed = F.abs(F.col("tokens") - due * F.sum("tokens").over(whole)) - F.col("longest") - due * F.sum("longest").over(whole)
    return rows.select("source", "max_repeat", (missed <= 1).alias("share_kept"), (F.col("max_uses") <= F.col("max_repeat")).alias("repeats_kept"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reading bands of the English documents."""
    return readability.reading_levels(spread(table(spark, folder, "documents")), table(spark, folder, "reading_labels")).select("doc_id", "band")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out errors of the reading bands by source."""
    return readability.reading_report(spread(table(spark, folder, "documents")), table(spark, folder, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_redacted, p2_found, p3_found, p3_groups, p4_packed, p4_report, p4_invariants, p5_budget, p5_records, p6_found, p6_members, p6_report, p7_ids, p7_roundtrip, p8_mixture, p8_shares, p8_limits, p9_found, p9_report)
}

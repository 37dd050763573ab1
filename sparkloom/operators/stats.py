"""Summaries and length profiles, each one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import patterns as P
from sparkloom.functions.messages import turn_count


def count_by(rows: DataFrame, *columns: str, missing: str | None = None) -> DataFrame:
    """Rows per combination of columns; ``missing`` names the null ones."""
    named = rows.select(*[F.coalesce(c, F.lit(missing)).alias(c) if missing is not None else F.col(c) for c in columns])
    return named.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """(by, name, n): rows in all, by source and by task, in one pass."""
    sets = rows.groupingSets([[], ["source"], ["task"]], "source", "task").agg(F.grouping("source").alias("gs"), F.grouping("task").alias("gt"), F.count(F.lit(1)).alias("n"))
    by = F.when(F.col("gs") == 0, "source").when(F.col("gt") == 0, "task").otherwise("all")
    return sets.select(by.alias("by"), F.coalesce("source", "task").alias("name"), "n")


def turn_stats(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, and the sum, mean (3 places) and maximum of messages but the system ones, or of a column ``turns`` that has their number; 0 where there are no rows."""
    turns = F.col("turns") if "turns" in rows.columns else F.coalesce(F.greatest(turn_count(F.col("messages")), F.lit(0)), F.lit(0)).cast("long")
    return rows.select(*by, turns.alias("_t")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_t"), F.lit(0)).alias("turns"), F.coalesce(F.round(F.avg("_t"), 3), F.lit(0.0)).alias("avg_turns"), F.coalesce(F.max("_t"), F.lit(0)).alias("max_turns")
    )


def length_profile(lengths: DataFrame, column: str = "length", limit: int = 2048, *by: str) -> DataFrame:
    """Count, mean, maximum, exact percentiles (interpolated) and the share beyond ``limit``. No lengths give a count of 0 and nulls."""
    shares = F.percentile(F.col(column), F.array(*[F.lit(p / 100) for p in P.LENGTH_PERCENTILES]))
    out = lengths.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.max(column).cast("long").alias("max"), shares.alias("_p"),
        F.count(F.when(F.col(column) > limit, 1)).alias("n_over"),
    )
    return out.select(*by, "n", "mean", "max", *[F.get("_p", i).alias(f"p{p}") for i, p in enumerate(P.LENGTH_PERCENTILES)], "n_over", (F.col("n_over") / F.nullif("n", F.lit(0))).alias("share_over"))


def length_histogram(lengths: DataFrame, column: str = "length", edges: Sequence[int] = P.LENGTH_EDGES) -> DataFrame:
    """(low, high, n): lengths above ``low`` and up to ``high``, empty buckets kept; the last has no ``high``. A length of 0 is in none."""
    bounds = list(zip(edges, [*edges[1:], None]))
    inside = lambda lo, hi: (F.col(column) > lo) & (F.col(column) <= hi if hi is not None else F.lit(True))
    row = lengths.agg(*[F.count(F.when(inside(lo, hi), 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(bounds)])
    buckets = [F.struct(F.lit(lo).cast("long").alias("low"), F.lit(hi).cast("long").alias("high"), F.col(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(bounds)]
    return row.select(F.explode(F.array(*buckets)).alias("b")).select("b.*")


def kept_counts(rows: DataFrame, keep: Column, *by: str) -> DataFrame:
    """Rows before and after a filter."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(keep, 1)).alias("kept"))

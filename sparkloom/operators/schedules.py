"""Closed forms for training plans: layer-wise rates, step budgets, parameter groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_DECAY = ("bias", "LayerNorm.bias", "LayerNorm.weight")


def layer_rates(spark: SparkSession, layers: int, base: float = 2e-5, decay: float = 0.9) -> DataFrame:
    """(part, layer, rate): head at the base rate, layer i of n at base * decay^(n-1-i), embeddings at base * decay^n."""
    rows = spark.range(layers).select(F.lit("layer").alias("part"), F.col("id").alias("layer"), (F.lit(base) * F.pow(F.lit(decay), F.lit(layers - 1) - F.col("id"))).alias("rate"))
    ends = spark.createDataFrame([("head", None, base), ("embeddings", None, base * decay**layers)], "part string, layer long, rate double")
    return rows.unionByName(ends)


def step_budget(rows: Column, batch: int, epochs: int, warmup: float) -> tuple[Column, Column]:
    """(steps in all, of them warm-up): at least one step an epoch; warm-up steps are cut to a whole number."""
    steps = F.greatest(F.floor(rows / batch), F.lit(1)) * epochs
    return steps, F.floor(steps * warmup)


def linear_rate(step: Column, steps: int, warmup: int, base: float) -> Column:
    """The rate at a step: rising in a line over the warm-up, then falling in a line to 0."""
    rising = step / max(1, warmup)
    falling = F.greatest(F.lit(0.0), (F.lit(steps) - step) / max(1, steps - warmup))
    return base * F.when(step < warmup, rising).otherwise(falling)


def trainable_percent(trainable: Column, whole: Column) -> Column:
    """100 a / b; null over nothing."""
    return 100.0 * trainable / F.nullif(whole, F.lit(0))


def decay_group(name: Column) -> Column:
    """Whether weight decay applies to a parameter, by its name."""
    return F.when(name.rlike("|".join(n.replace(".", r"\.") for n in NO_DECAY)), "no_decay").otherwise("decay")

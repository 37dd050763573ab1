"""Splitting, drawing and shuffling, the same for a seed on any cluster.

Order comes from ``md5(seed|id)``. No source is sorted in one task: each is cut into
buckets by the first hex digits of that hash, bucket sizes are counted, and a row's
rank is the rows of earlier buckets plus its rank within its bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.messages import repeated_id
from sparkloom.plans.config import MixtureTarget, SplitSize

#: Hex digits of the hash that name a bucket, at least: 4,096 buckets a group; and rows of a group in a bucket, about, where it is known how many rows there are.
BUCKET_DIGITS, BUCKET_ROWS = 3, 100_000


def bucket_digits(rows: int) -> int:
    """Digits under which a bucket of a group of all these rows holds at most about BUCKET_ROWS of them."""
    digits = BUCKET_DIGITS
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def seeded(seed: Column | int, *parts: Column | str) -> Column:
    """What rows are shuffled by."""
    return F.md5(F.concat_ws("|", (F.lit(seed) if isinstance(seed, int) else seed).cast("string"), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts]))


def ranked(rows: DataFrame, group: Sequence[str], key: Column, tie: Sequence[str], rank: str = "_rank", size: str = "_size", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Rows with their rank (from 1) by ``key`` then ``tie`` within the group, and the size of the group. ``digits``: see :func:`bucket_digits`."""
    keyed = rows.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    starts = counts.select(*group, "_bucket", (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias(size))
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_key", *tie))
    left, right = keyed.withColumn("_within", within).alias("l"), starts.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, "_bucket")]
    joined = left.join(right, same)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("r._before") + F.col("l._within")).alias(rank), F.col(f"r.{size}"))


def _table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))  # a list of settings


def split_random(rows: DataFrame, sizes: Sequence[SplitSize], pos: str = "pos", own_id: str = "id", source: str = "source", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Rows of the named sources with ``split``: the first by shuffled order are test, the next val, the rest train. Scarce sources fill test first."""
    plan = _table(rows.sparkSession, [(s.source, s.val, s.test, s.seed) for s in sizes], "_s string, _val int, _test int, _seed int")
    joined = rows.join(plan, F.col(source) == F.col("_s"))
    out = ranked(joined, [source], seeded(F.col("_seed"), own_id), [pos], digits=digits)
    split = F.when(F.col("_rank") <= F.col("_test"), "test").when(F.col("_rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train")
    return out.withColumn("split", split).drop("_s", "_val", "_test", "_seed", "_rank", "_size")


def draw_to_targets(rows: DataFrame, targets: Sequence[MixtureTarget], pos: str = "pos", own_id: str = "id", source: str = "source", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exactly the wanted number of rows of each stage and source: a draw without repetition, or whole shuffled passes and a part of one.

    Adds ``stage`` and ``repeat_idx``; repetitions get ids of their own. A target of 0 or
    less, or a source without rows, gives none.
    """
    spark = rows.sparkSession
    plan = _table(spark, [(t.stage, t.source, t.target, t.seed) for t in targets if t.target > 0], "stage string, _s string, _target int, _seed int")
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_have"))
    passes = plan.join(sizes, F.col("_s") == F.col(source)).select("stage", "_s", "_target", "_seed", "_have", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_target") / F.col("_have")).cast("int") - 1)).alias("repeat_idx"))
    # Whole passes take every row; only the last one is ranked.
    joined = rows.join(F.broadcast(passes), F.col(source) == F.col("_s"))
    last = F.col("_target") - F.col("_have") * F.col("repeat_idx")
    full = joined.where(last >= F.col("_have"))
    part = ranked(joined.where(last < F.col("_have")), ["stage", source], seeded(F.col("_seed"), F.col("repeat_idx"), own_id), [pos], digits=digits)
    part = part.where(F.col("_rank") <= last).drop("_rank", "_size")
    both = full.unionByName(part)
    return both.withColumn(own_id, repeated_id(F.col(own_id), F.col("repeat_idx"))).drop("_s", "_target", "_seed", "_have")


def shuffled(rows: DataFrame, seed: int, own_id: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """All rows in an order the seed determines, one group after the other if ``within`` names any: a range partitioning, not a single task."""
    return rows.orderBy(*within, seeded(seed, own_id))


def stratified_split(rows: DataFrame, own_id: str, label: str, seed: int = 42, held_out: float = 0.2, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Train, val and test with the labels' proportions: of each label the first ``held_out`` share by shuffled order, half val, half test.

    The held-out rows of a label are its share rounded half up; an odd one goes to test.
    """
    out = ranked(rows, [label], seeded(seed, own_id), [own_id], digits=digits)
    held = F.floor(F.col("_size") * held_out + 0.5)
    split = F.when(F.col("_rank") <= F.floor(held / 2), "val").when(F.col("_rank") <= held, "test").otherwise("train")
    return out.withColumn("split", split).drop("_rank", "_size")


def head(rows: DataFrame, n: int | None, pos: str = "pos") -> DataFrame:
    """The first rows by position; None or 0 gives all."""
    return rows.orderBy(pos).limit(n) if n else rows

"""Whole dataset builds: pools, splits, deduplication, draws and their statistics, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.messages import computed, full_signature, normalize_messages, turn_count, user_signature
from sparkloom.functions.text import normal_name
from sparkloom.operators.dedup import dedup_by_priority, dedup_lenient_strict, dedup_pool
from sparkloom.operators.sampling import bucket_digits, draw_to_targets, split_random
from sparkloom.operators.stats import count_by, turn_stats
from sparkloom.plans.config import MixturePlan
from sparkloom.plans.durable import durable


def signed(rows: DataFrame) -> DataFrame:
    """Rows with ``user_sig`` and ``full_sig`` of their cleaned messages."""
    return computed(rows, {"user_sig": user_signature(F.col("messages"), cleaned=True), "full_sig": full_signature(F.col("messages"))})


def pool_of_records(records: DataFrame, nfkc: bool = True) -> DataFrame:
    """Delivered examples as a pool: pos, id, split (train, val, test), source, task, messages (user and assistant, cleaned), signatures. Rows without such messages are left out."""
    split = F.lower(F.trim("split"))
    rows = records.select(
        F.col("record_id").alias("pos"), "id", F.when(split.isin("valid", "validation"), "val").otherwise(split).alias("split"), normal_name(F.col("source")).alias("source"), normal_name(F.col("task")).alias("task"),
        F.col("messages").alias("_raw"),
    ).where("size(_raw) > 0")
    return signed(computed(rows, {"messages": normalize_messages(F.col("_raw"), nfkc)}).drop("_raw").where("size(messages) > 0"))


#: What splitting, deduplication and draws need of an example: its texts stay where they are until it is written.
SLIM = ("pos", "id", "source", "split", "user_sig", "full_sig", "turns")


def slim(pools: DataFrame) -> DataFrame:
    """Examples without their texts: the signature of the first question by its hash, as that of the dialogue is one, and the number of messages but the system ones."""
    turns = F.coalesce(F.greatest(turn_count(F.col("messages")), F.lit(0)), F.lit(0)).cast("long")
    return pools.withColumns({"turns": turns, "user_sig": F.md5("user_sig")}).select(*SLIM)


@dataclass(frozen=True)
class Mixture:
    """Examples before and after deduplication and the drawn stages, without texts; and the pools that have those."""

    texts: DataFrame
    pools: DataFrame
    unique: DataFrame
    drawn: DataFrame

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """Rows of the mixture with task, messages and meta of their example; a source's positions are unique."""
        return rows.join(self.texts.select("source", "pos", "task", "messages", "meta"), ["source", "pos"])

    def stats(self) -> DataFrame:
        """(part, split, source, n, turns, avg_turns, max_turns): sizes before and after deduplication, and of each stage."""
        named = lambda df, part, split: turn_stats(df, *split, "source").select(part.alias("part"), *([F.col("split")] if split else [F.lit("train").alias("split")]), "source", "n", "turns", "avg_turns", "max_turns")
        stages = turn_stats(self.drawn, "stage", "source").select(F.col("stage").alias("part"), F.lit("train").alias("split"), "source", "n", "turns", "avg_turns", "max_turns")
        return named(self.pools, F.lit("pool"), ["split"]).unionByName(named(self.unique, F.lit("unique"), ["split"])).unionByName(stages)


def _slim_once(pools: DataFrame) -> tuple[DataFrame, int]:
    """The one pass over the texts: slim examples, written, and the digits their buckets need."""
    rows = durable(slim(pools), "examples")
    return rows, bucket_digits(rows.count())


def dialogue_mixture(pools: DataFrame, plan: MixturePlan) -> Mixture:
    """Sources without official splits are split first, then deduplicated within each split by priority (some leniently), then drawn."""
    rows, digits = _slim_once(pools)
    own = [s.source for s in plan.splits]
    divided = split_random(rows.where(F.col("source").isin(*own)).drop("split"), plan.splits, digits=digits) if own else rows.limit(0)
    every = durable(rows.where(~F.col("source").isin(*own)).unionByName(divided), "pools") if own else rows
    unique = durable(dedup_lenient_strict(every, plan.priority, plan.lenient), "unique")
    return Mixture(pools, every, unique, draw_to_targets(unique.where("split = 'train'"), plan.targets, digits=digits))


def knowledge_mixture(pools: DataFrame, plan: MixturePlan) -> Mixture:
    """Sources are deduplicated in themselves before they are split, then across sources by priority, then drawn."""
    rows, digits = _slim_once(pools)
    own = [s.source for s in plan.splits]
    clean = dedup_pool(rows.where(~F.col("source").isin(*own)), within=("source", "split"))
    # Ranks read their rows twice, so what is deduplicated is written before.
    divided = split_random(durable(dedup_pool(rows.where(F.col("source").isin(*own)), within=("source",)).drop("split"), "clean"), plan.splits, digits=digits) if own else rows.limit(0)
    every = durable(clean.unionByName(divided), "pools")
    unique = durable(dedup_by_priority(every, plan.priority), "unique")
    return Mixture(pools, every, unique, draw_to_targets(unique.where("split = 'train'"), plan.targets, digits=digits))


def pool_sizes(mixture: Mixture) -> DataFrame:
    """(part, split, source, n) before and after deduplication."""
    sized = lambda df, part: count_by(df, "split", "source").select(F.lit(part).alias("part"), "split", "source", "n")
    return sized(mixture.pools, "before").unionByName(sized(mixture.unique, "after"))

"""Mixing sources to target shares of the total tokens.

Each source's texts are shuffled into a line of tokens, once per repetition, and cut
into blocks of equal size. A golden-ratio sequence mapped through the cumulative shares
names the source of every slot; the r-th slot of a source takes its r-th block. So any
stretch of the mixture holds the shares closely, and nothing is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import normal_name
from sparkloom.llm.tokens import TOKENIZER, text_tokens
from sparkloom.plans.durable import durable

#: Tokens of a block, texts of a shuffling bucket, slots numbered together.
BLOCK_TOKENS, BUCKET_ROWS, CHUNK_SLOTS = 8192, 10_000, 4096
#: Targets at most: their list is read by the driver and broadcast.
MOST_TARGETS = 10_000
_GOLDEN = (math.sqrt(5) - 1) / 2


def _wanted(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, max_repeat) of each target. Targets are a list of settings: at most MOST_TARGETS."""
    rows = targets.groupBy(normal_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeat").alias("most")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources")
    return [(r.source, float(r.share or 0), int(r.most or 0)) for r in rows]


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[tuple[str, float, int, int, int]]:
    """(source, share, max_repeat, tokens there, tokens wanted) of each target."""
    wanted = _wanted(targets)
    have = {r.source: r.tokens for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).limit(MOST_TARGETS + 1).collect()}  # of targets only
    rows = [(*r, int(have.get(r[0]) or 0)) for r in wanted]
    usable = [r for r in rows if r[1] > 0 and r[2] > 0 and r[3] > 0]
    whole = sum(r[1] for r in usable)
    total = min((r[2] * r[3] * whole / r[1] for r in usable), default=0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    return [(*r, int(total * r[1] / whole) if r in usable else 0) for r in rows]


def sized_texts(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the texts with tokens whose source is a target; sources with spelling variants brought together."""
    rows = documents.select("doc_id", normal_name(F.col("source")).alias("source"), "text").where("text is not null and text <> ''")
    names = [(s,) for s, *_ in _wanted(targets)]  # a list of settings, checked
    if not names:
        return text_tokens(rows.limit(0), "text", ["doc_id", "source"], tokenizer)
    known = F.broadcast(documents.sparkSession.createDataFrame(names, "source string"))
    return durable(text_tokens(rows.join(known, "source", "left_semi"), "text", ["doc_id", "source"], tokenizer), "sizes")


def mixture(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """The mixture, one row per use of a text: slot, source, pass, block_offset, doc_id, n_tokens.

    ``slot`` orders the mixture; within it ``block_offset`` does. Without ``total_tokens``
    the mixture is as large as the scarcest source allows at ``max_repeat`` uses of each
    text. A target whose source has no text gets nothing; the others keep their
    proportions. A text belongs to the block in which it starts and is never cut; a
    source's tokens miss their aim by less than one text. Null or zero shares and
    repeats take no text; a target given twice counts with its shares added and the
    smaller repeat. Null ids are kept. Empty tables give no rows.
    """
    spark = sized.sparkSession
    plan = [r for r in _plan(sized, targets, total_tokens) if r[4] > 0]
    if not plan:
        return spark.createDataFrame([], "slot long, source string, pass int, block_offset long, doc_id long, n_tokens long")
    wanted = sum(r[4] for r in plan)
    aims = spark.createDataFrame([(s, have, aim, -(-aim // have)) for s, _, _, have, aim in plan], "source string, have long, aim long, passes int")
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))

    # A line of tokens per source: repetition, bucket, then order within the bucket.
    uses = sized.where("n_tokens > 0").join(F.broadcast(aims), "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.withColumn("mixed", F.xxhash64("doc_id", "pass", F.lit(seed))).withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
    sums = uses.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "pass", "bucket", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("source", "pass", "bucket").orderBy("mixed", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    line = uses.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["source", "pass", "bucket"])
    line = line.withColumn("at", F.col("pass") * F.col("have") + F.col("bucket_start") + F.col("before")).where(F.col("at") + F.col("n_tokens") / 2 <= F.col("aim"))
    line = line.withColumn("rank", F.floor(F.col("at") / block_tokens))

    # The schedule: enough slots that each source has one for each of its blocks.
    weights, at = [], 0.0
    for s, *_, aim in plan:
        weights.append((s, at, at + aim / wanted))
        at += aim / wanted
    spare = 16 + 4 * math.log2(wanted / block_tokens + 2)
    slots = math.ceil(max((r[4] / block_tokens + spare) * wanted / r[4] for r in plan))
    point = F.pmod((F.col("id") + 1) * F.lit(_GOLDEN), F.lit(1.0))
    # Each source covers a range of equal cells; a slot meets the few sources that share its cell.
    cells = 4 * len(weights)
    ranges = [(c, s, start, end if i + 1 < len(weights) else 2.0) for i, (s, start, end) in enumerate(weights) for c in range(int(start * cells), min(cells - 1, int((end if i + 1 < len(weights) else 1.0) * cells)) + 1)]
    cell = F.least(F.floor(point * cells), F.lit(cells - 1)).cast("int")
    slots_of = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), cell.alias("cell"))
    covered = F.broadcast(spark.createDataFrame(ranges, "cell int, source string, from double, upto double"))  # five rows a target
    schedule = slots_of.join(covered, "cell").where("point >= `from` and point < upto").select("slot", "source", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    per_chunk = schedule.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("source", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chunk_start"))
    in_chunk = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot"))
    schedule = schedule.withColumn("nth", in_chunk).join(per_chunk, ["source", "chunk"]).select("slot", "source", (F.col("chunk_start") + F.col("nth") - 1).alias("rank"))
    return line.join(schedule, ["source", "rank"]).select("slot", "source", "pass", (F.col("at") % block_tokens).alias("block_offset"), F.col("doc_id").cast("long").alias("doc_id"), "n_tokens")


def mixture_shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses, max_uses, max_repeat, available_tokens) of each target; shares are of the mixture's tokens."""
    by_text = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = by_text.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("max_uses"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    names = targets.groupBy(normal_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeat").alias("max_repeat"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = names.join(got, "source", "left").join(have, "source", "left").join(F.broadcast(whole), F.lit(True), "left")
    share = F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share")
    return rows.select("source", "target_share", share, zero("tokens"), zero("uses"), zero("max_uses"), "max_repeat", zero("available_tokens"))

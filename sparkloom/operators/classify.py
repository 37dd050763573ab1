"""Cleaning labelled sentences and measuring predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import normal_label, squeeze
from sparkloom.operators.dedup import drop_exact_duplicates, without_conflicts

LABELS = ("negative", "neutral", "positive")


def clean_sentences(rows: DataFrame, labels: Sequence[str] = LABELS, label: str = "label", sentence: str = "sentence", null_sentence: str = "nan") -> DataFrame:
    """(label, sentence): normalised, with a known label and something in the sentence, each once, none under two labels.

    A null sentence is the text ``null_sentence``, as text made of a missing value is; ''
    leaves such rows out. A null label is none of the known ones.
    """
    even = rows.select(normal_label(F.col(label)).alias("label"), squeeze(F.coalesce(F.col(sentence).cast("string"), F.lit(null_sentence))).alias("sentence"))
    return without_conflicts(drop_exact_duplicates(even.where((F.col("sentence") != "") & F.col("label").isin(*labels)), ["label", "sentence"]))


def encode_label(label: Column, labels: Sequence[str] = LABELS) -> Column:
    """The place of a label, from 0; null for others."""
    place = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(place > 0, (place - 1).cast("int"))


def decode_label(number: Column, labels: Sequence[str] = LABELS) -> Column:
    """The label at a place; null beyond."""
    return F.get(F.array(*map(F.lit, labels)), number)


def map_values(value: Column, names: Mapping[str, str]) -> Column:
    """A lookup in a small fixed mapping; null where it has no entry."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value)


def argmax(scores: Column) -> Column:
    """The place of the first greatest score, from 0; null for an empty or null array."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def _cells(predictions: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts of each pair of gold and predicted label that occurs: at most the square of the number of labels."""
    return predictions.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(predictions: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) of each label that occurs on either side; a ratio over nothing is 0. Rows with a null are left out."""
    each = _cells(predictions, gold, pred).select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("x")).select("x.*")
    sums = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("support"), F.sum("p").alias("predicted"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    scored = sums.select("label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")
    return scored


def accuracy(predictions: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(n, correct, accuracy) over rows without nulls."""
    fine = predictions.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    return fine.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(gold) == F.col(pred), 1)).alias("correct"), F.avg(F.when(F.col(gold) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))


def averages(predictions: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(average, precision, recall, f1, support): macro, the plain mean over labels, and weighted by support."""
    scores = class_scores(predictions, gold, pred)
    measures = ("precision", "recall", "f1")
    row = scores.agg(*[F.avg(m).alias(f"macro_{m}") for m in measures], *[(F.sum(F.col(m) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias(f"weighted_{m}") for m in measures], F.sum("support").alias("support"))
    kinds = [F.struct(F.lit(k).alias("average"), *[F.col(f"{k}_{m}").alias(m) for m in measures], F.col("support")) for k in ("macro", "weighted")]
    return row.select(F.explode(F.array(*kinds)).alias("a")).select("a.*")


def confusion(predictions: DataFrame, labels: Sequence, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per gold label of the full list, one column ``pred_<label>`` per predicted one; zeros are kept."""
    spark = predictions.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], ["gold"])
    cells = _cells(predictions, gold, pred)
    wide = cells.groupBy("gold").agg(*[F.sum(F.when(F.col("pred") == x, F.col("n")).otherwise(0)).alias(f"pred_{x}") for x in labels])
    return every.join(wide, "gold", "left").select("gold", *[F.coalesce(f"pred_{x}", F.lit(0)).alias(f"pred_{x}") for x in labels])


def report(predictions: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(name, precision, recall, f1, support): a row per label, then accuracy, macro and weighted averages."""
    scores = class_scores(predictions, gold, pred).select(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    right = accuracy(predictions, gold, pred).select(F.lit("accuracy").alias("name"), *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1")], F.col("n").alias("support"))
    return scores.unionByName(right).unionByName(averages(predictions, gold, pred).withColumnRenamed("average", "name"))


def compute_metrics(predictions: DataFrame, gold: str = "gold", pred: str = "pred") -> dict[str, float]:
    """Accuracy, and macro and weighted precision, recall and F1, by name: what a trainer asks of its metric callback. No rows give zeros."""
    out = {"accuracy": float(accuracy(predictions, gold, pred).first().accuracy or 0.0)}
    for r in averages(predictions, gold, pred).collect():  # two rows
        out |= {f"{r.average}_{m}": float(r[m] or 0.0) for m in ("precision", "recall", "f1")}
    return out

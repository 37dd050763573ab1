"""Writers. What grows with the data is written by the executors; reports are small and go through the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import classify
from sparkloom.sources.files import write_text

KEY_ORDER = ("source", "task", "messages", "meta", "id")
#: Rows a report may have; a larger one isn't a report.
MOST_REPORT_ROWS = 100_000


def write_jsonl(rows: DataFrame, path: str, keep_nulls: bool = True, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8 with the usual order of keys first."""
    known = [c for c in KEY_ORDER if c in rows.columns]
    rows.select(*known, *[c for c in rows.columns if c not in known]).write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def _written(rows: DataFrame, path: str) -> int:
    """Write JSON lines; the number written, counted on the way."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_judge_jsonl(rows: DataFrame, path: str) -> int:
    """Judge rows as JSON lines; the number written. None at all is an error."""
    n = _written(rows, path)
    if not n:
        raise ValueError("no benchmark row has a response")
    return n


def write_generations(rows: DataFrame, path: str, prompt_id: str = "prompt_id", response: str = "response") -> int:
    """Responses as JSON lines of prompt_id and response only; the number written."""
    return _written(rows.select(F.col(prompt_id).alias("prompt_id"), F.col(response).alias("response")), path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predictions as CSV with a header."""
    rows.select("gold_label_id", "gold_label", "pred_label_id", "pred_label").write.mode("overwrite").option("header", True).csv(path)


def report_rows(rows: DataFrame) -> list[dict[str, Any]]:
    """The rows of a small report, with its size checked."""
    got = rows.limit(MOST_REPORT_ROWS + 1).collect()
    if len(got) > MOST_REPORT_ROWS:
        raise ValueError("too many rows for a report")
    return [r.asDict(recursive=True) for r in got]


def _plain(value: Any) -> Any:
    if isinstance(value, DataFrame):
        return report_rows(value)
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_report(spark: SparkSession, path: str, **parts: DataFrame | dict | list | int | float | str) -> None:
    """One JSON document of small tables, numbers and settings, on any file system."""
    write_text(spark, path, json.dumps(_plain(parts), ensure_ascii=False, indent=2, default=str))


def write_run(out: str, config: Mapping[str, Any], summaries: Mapping[str, DataFrame], samples: Mapping[str, DataFrame], metrics: Mapping[str, Mapping[str, float]] | None = None) -> None:
    """What a training run leaves beside its model: dataset_summary.json, run_config.json, and <split>_results.json of its metrics with the number of samples."""
    spark = next(iter([*summaries.values(), *samples.values()])).sparkSession
    write_report(spark, f"{out}/dataset_summary.json", **summaries)
    write_report(spark, f"{out}/run_config.json", **config)
    for split, rows in samples.items():
        write_report(spark, f"{out}/{split}_results.json", **{**(metrics or {}).get(split, {}), f"{split}_samples": rows.count()})


def write_evaluation(predictions: DataFrame, out: str, labels: Sequence[str] = classify.LABELS) -> None:
    """An evaluated classifier: metrics.json, confusion_matrix.json, classification_report.json and predictions.csv of (gold_label_id, pred_label_id)."""
    spark = predictions.sparkSession
    named = predictions.select("gold_label_id", "pred_label_id")
    write_report(spark, f"{out}/metrics.json", **classify.compute_metrics(named, "gold_label_id", "pred_label_id"))
    cells = report_rows(classify.confusion(named, range(len(labels)), "gold_label_id", "pred_label_id").orderBy("gold"))
    write_report(spark, f"{out}/confusion_matrix.json", labels=list(labels), matrix=[[r[f"pred_{i}"] for i in range(len(labels))] for r in cells])
    write_report(spark, f"{out}/classification_report.json", rows=classify.report(named, "gold_label_id", "pred_label_id"))
    write_predictions(named.select("gold_label_id", classify.decode_label(F.col("gold_label_id"), labels).alias("gold_label"), "pred_label_id", classify.decode_label(F.col("pred_label_id"), labels).alias("pred_label")), f"{out}/predictions.csv")


def console(rows: DataFrame, n: int = 20) -> str:
    """The first rows as text."""
    return rows.select(*[F.col(c) for c in rows.columns])._show_string(n, False)

"""Joining generated responses to benchmark prompts, with what is left over on either side.

Prompts have no size bound known beforehand, so no side is broadcast by hint; Spark does
it below its own threshold. Responses are made unique before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.messages import as_response


def last_responses(generated: DataFrame) -> DataFrame:
    """(prompt_id, response, line_no, n): the last line of each prompt, and how many lines it had. A null response is the text 'None'; rows without prompt id are left out."""
    rows = generated.where("prompt_id is not null").select(F.col("prompt_id").cast("string").alias("prompt_id"), F.coalesce(F.col("response").cast("string"), F.lit("None")).alias("response"), "line_no")
    return rows.groupBy("prompt_id").agg(F.max_by("response", "line_no").alias("response"), F.max("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"))


def judge_rows(benchmark: DataFrame, generated: DataFrame) -> DataFrame:
    """Each benchmark row that has a response, with it as the assistant's message; repeated benchmark rows all come out."""
    answers = last_responses(generated).select("prompt_id", as_response(F.col("response")).alias("prompt_response"))
    rows = benchmark.withColumn("prompt_id", F.col("prompt_id").cast("string"))
    return rows.join(answers, "prompt_id").select("prompt_id", "prompt", "prompt_response", "rubrics", "example_tags")


def unanswered(benchmark: DataFrame, generated: DataFrame) -> DataFrame:
    """Benchmark rows without a response."""
    return benchmark.join(generated.select("prompt_id").where("prompt_id is not null"), "prompt_id", "left_anti")


def unmatched_ids(benchmark: DataFrame, generated: DataFrame) -> DataFrame:
    """Distinct prompt ids of responses that no benchmark row has."""
    return generated.select("prompt_id").where("prompt_id is not null").subtract(benchmark.select("prompt_id"))


def duplicate_ids(generated: DataFrame) -> DataFrame:
    """Prompt ids with more than one response, and how many."""
    return generated.where("prompt_id is not null").groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconciliation(benchmark: DataFrame, generated: DataFrame) -> DataFrame:
    """(written, skipped, unmatched, duplicated): rows with and without response, responses without row, ids with several."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [one(judge_rows(benchmark, generated), "written"), one(unanswered(benchmark, generated), "skipped"), one(unmatched_ids(benchmark, generated), "unmatched"), one(duplicate_ids(generated), "duplicated")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))  # one row each
    return out


def require_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows, or ValueError naming the columns that are missing."""
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; there are {sorted(rows.columns)}")
    return rows

"""A small local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}".strip(":")

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    """A Spark session."""
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MESSAGES = "array<struct<role:string,content:string>>"


@pytest.fixture(scope="session")
def records(spark):
    """A maker of finetune_data rows from (record_id, messages as (role, content) pairs or None) with defaults for the rest."""

    def make(rows, split="train", source="chat", extra=""):
        data = []
        for row in rows:
            record_id, messages, *rest = row
            data.append((record_id, rest[0] if rest else split, rest[1] if len(rest) > 1 else source, "task", messages))
        out = spark.createDataFrame(data, f"record_id long, split string, source string, task string, messages {MESSAGES}")
        return out.selectExpr("*", *(extra.split(";") if extra else []))

    return make

"""Plans are what they should be: pruned scans, no Python where none is needed, trimmed groups, top-k without a full sort."""

from __future__ import annotations

import os
import re

import pytest
from conftest import TESTDATA

import __spark_entry__ as entry

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    schema = re.findall(r"ReadSchema: (\S+)", plan(spark, "summary"))
    assert schema == ["struct<source:string,task:string>"]
    assert re.findall(r"ReadSchema: (\S+)", plan(spark, "split_random"))
    assert "messages" not in " ".join(re.findall(r"ReadSchema: (\S+)", plan(spark, "stratified_split")))


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan(spark, "scalar_series")


@pytest.mark.parametrize("name", ["merge_turns", "signatures", "dedup_pool", "judge_join", "class_report", "mixture_draws", "strip_tail"])
def test_no_python_per_row(spark, name):
    got = plan(spark, name)
    assert "BatchEvalPython" not in got and "CartesianProduct" not in got


def test_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "judge_unmatched_top10")


def test_groups_are_trimmed_before_the_shuffle(spark):
    for name in ("dedup_pool", "dedup_priority", "dedup_lenient_strict"):
        assert "WindowGroupLimit" in plan(spark, name)

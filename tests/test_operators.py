"""Relational operators against sequential models and small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import builders, chat, classify, dedup, judge, sampling, schedules, stats
from sparkloom.plans.config import DialogueRules, MixturePlan, MixtureTarget, SplitSize

PRIORITY = ("a", "b", "c", "d")


def random_rows(seed, n=200):
    """Rows in which equal whole dialogues have equal first questions."""
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        user = rng.choice(["", "q1", "q2", "q3", "q4", "q5", "q6", None])
        rows.append((pos, rng.choice(["train", "val"]), rng.choice(PRIORITY), user, f"{user}|{rng.randint(0, 2)}"))
    return rows


@pytest.fixture(params=[1, 2, 3])
def rows(spark, request):
    data = random_rows(request.param)
    return data, spark.createDataFrame(data, "pos long, split string, source string, user_sig string, full_sig string")


def kept(df):
    return sorted(r.pos for r in df.select("pos").collect())


def test_dedup_pool(rows):
    data, df = rows
    seen, want = set(), []
    for pos, split, _, user, full in data:
        if (split, user) not in seen and (split, "f", full) not in seen:
            want.append(pos)
            seen |= {(split, user), (split, "f", full)}
    assert kept(dedup.dedup_pool(df)) == want


def test_dedup_by_priority(rows):
    data, df = rows
    seen, want = set(), []
    for pos, split, _, user, _ in sorted(data, key=lambda r: (PRIORITY.index(r[2]), r[0])):
        if (split, user) not in seen:
            want.append(pos)
            seen.add((split, user))
    assert kept(dedup.dedup_by_priority(df, PRIORITY)) == sorted(want)


def test_dedup_lenient_strict(rows):
    data, df = rows
    full_seen, user_seen, want = set(), set(), []
    for pos, split, source, user, full in sorted(data, key=lambda r: (PRIORITY.index(r[2]), r[0])):
        if (split, full) in full_seen or (source in "cd" and (split, user) in user_seen):
            continue
        want.append(pos)
        full_seen.add((split, full))
        user_seen.add((split, user))
    assert kept(dedup.dedup_lenient_strict(df, PRIORITY, ("a", "b"))) == sorted(want)
    with pytest.raises(ValueError):
        dedup.dedup_lenient_strict(df, PRIORITY, ("c",))


def test_first_per_group_is_trimmed_before_the_shuffle(spark, rows):
    plan = dedup.dedup_pool(rows[1])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_splits(spark):
    df = spark.createDataFrame([(i, f"id{i % 40}", "s" if i < 50 else "t") for i in range(60)], "pos long, id string, source string")
    out = sampling.split_random(df, [SplitSize("s", 7, 9, 1), SplitSize("t", 5, 8, 2)]).collect()
    sizes = {}
    for r in out:
        sizes[r.source, r.split] = sizes.get((r.source, r.split), 0) + 1
    assert sizes == {("s", "test"): 9, ("s", "val"): 7, ("s", "train"): 34, ("t", "test"): 8, ("t", "val"): 2}
    again = sampling.split_random(df.repartition(7), [SplitSize("s", 7, 9, 1), SplitSize("t", 5, 8, 2)]).collect()
    assert {(r.pos, r.split) for r in out} == {(r.pos, r.split) for r in again}
    assert sampling.split_random(df.limit(0), [SplitSize("s", 1, 1, 1)]).count() == 0


@pytest.mark.parametrize("target", [0, 3, 10, 11, 20, 27])
def test_draws(spark, target):
    df = spark.createDataFrame([(i, f"id{i}", "s") for i in range(10)], "pos long, id string, source string")
    out = sampling.draw_to_targets(df, [MixtureTarget("x", "s", target, 5), MixtureTarget("x", "none", 5, 5)]).collect()
    assert len(out) == target
    uses = {}
    for r in out:
        uses[r.pos] = uses.get(r.pos, 0) + 1
        assert (r.repeat_idx == 0) == (r.id == f"id{r.pos}")
    assert not uses or max(uses.values()) - min([*uses.values()] if len(uses) == 10 else [*uses.values(), 0]) <= 1
    assert len({r.id for r in out}) == target


def test_stratified(spark):
    df = spark.createDataFrame([(i, "p" if i < 100 else "q") for i in range(150)], "id long, label string")
    got = {(r.label, r.split): r.n for r in sampling.stratified_split(df, "id", "label").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("p", "val"): 10, ("p", "test"): 10, ("p", "train"): 80, ("q", "val"): 5, ("q", "test"): 5, ("q", "train"): 40}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 512, 513, 8192, 8193)], "length long")
    got = {(r.low, r.high): r.n for r in stats.length_histogram(df).collect()}
    assert got[0, 512] == 2 and got[512, 1024] == 1 and got[4096, 8192] == 1 and got[8192, None] == 1 and len(got) == 8 and sum(got.values()) == 5
    assert stats.length_profile(df.limit(0)).collect()[0].n == 0


def test_turn_stats_of_nothing(spark):
    df = spark.createDataFrame([], "source string, messages array<struct<role:string,content:string>>")
    assert tuple(stats.turn_stats(df).collect()[0]) == (0, 0, 0.0, 0)


def test_judge(spark):
    prompts = spark.createDataFrame([("1", [], [], ["t"]), ("1", [], [], []), ("2", [], [], []), (None, [], [], [])], "prompt_id string, prompt array<string>, rubrics array<string>, example_tags array<string>")
    made = spark.createDataFrame([("1", "old", 1), ("1", None, 2), ("3", "x", 3), (None, "y", 4)], "prompt_id string, response string, line_no long")
    rows = judge.judge_rows(prompts, made).collect()
    assert [(r.prompt_id, r.prompt_response[0].content) for r in rows] == [("1", "None")] * 2
    assert tuple(judge.reconciliation(prompts, made).collect()[0]) == (2, 2, 1, 1)
    with pytest.raises(ValueError, match="missing columns"):
        judge.require_columns(prompts, "prompt_id", "nothing")


def test_class_measures(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (None, 1), (3, None)], "gold int, pred int")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in classify.class_scores(df).collect()}
    assert got == {0: (1.0, 0.5, pytest.approx(2 / 3), 2), 1: (pytest.approx(1 / 3), 1.0, 0.5, 1), 2: (0.0, 0.0, 0.0, 1)}
    macro = {r.average: r for r in classify.averages(df).collect()}
    assert macro["macro"].f1 == pytest.approx((2 / 3 + 0.5) / 3) and macro["weighted"].recall == pytest.approx(0.5)
    table = {r.gold: (r.pred_0, r.pred_1, r.pred_2) for r in classify.confusion(df, [0, 1, 2]).collect()}
    assert table == {0: (1, 1, 0), 1: (0, 1, 0), 2: (0, 1, 0)}
    scores = spark.createDataFrame([([0.1, 0.9, 0.9],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in scores.select(classify.argmax(F.col("s"))).collect()] == [1, None, None]


def test_conflicts(spark):
    df = spark.createDataFrame([(" Positive", "a  b"), ("negative", "a b "), ("neutral", "c"), ("neutral", "c"), ("odd", "d"), (None, "e"), ("neutral", None)], "label string, sentence string")
    assert sorted((r.label, r.sentence) for r in classify.clean_sentences(df).collect()) == [("neutral", "c"), ("neutral", "nan")]
    assert [(r.label, r.sentence) for r in classify.clean_sentences(df, null_sentence="").collect()] == [("neutral", "c")]
    assert classify.compute_metrics(spark.createDataFrame([], "gold int, pred int"))["accuracy"] == 0.0


def test_histories(spark):
    df = spark.createDataFrame([("x", 1, "user", "a"), ("x", 2, "user", " "), ("x", 3, "user", "b"), ("x", 4, "user", "Exit"), ("x", 5, "user", "c")], "conv_id string, turn int, role string, text string")
    assert [r.turn for r in chat.user_turns(df).orderBy("turn").collect()] == [1, 3]
    got = chat.history_prefixes(df.withColumnRenamed("text", "content")).orderBy("turn").collect()
    assert [len(r.history) for r in got] == [1, 2, 3, 4, 5]


def test_dense_position(spark):
    df = spark.range(0, 300, 3).withColumnRenamed("id", "k")
    got = chat.batch_numbers(chat.dense_position(df, "k"), 16).orderBy("k").collect()
    assert [r.pos for r in got] == list(range(100)) and [r.batch for r in got] == [i // 16 for i in range(100)]


def test_dense_position_of_many_rows(spark):
    df = spark.range(2_000_000, numPartitions=8).select(F.xxhash64("id").alias("k"), F.col("id").alias("other"))
    got = chat.dense_position(df, "k")
    r = got.agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.sum("other").alias("s")).first()
    assert (r.n, r.a, r.b, r.s) == (2_000_000, 0, 1_999_999, 1_999_999 * 1_000_000)
    ordered = got.where("pos < 1000").orderBy("pos").select("k").collect()
    assert ordered == sorted(ordered)


def test_bucket_digits():
    assert [sampling.bucket_digits(n) for n in (0, 10**6, 4 * 10**8, 10**9, 10**11)] == [3, 3, 3, 4, 5]


def test_schedules(spark):
    rates = {(r.part, r.layer): r.rate for r in schedules.layer_rates(spark, 2, 1.0, 0.5).collect()}
    assert rates == {("layer", 0): 0.5, ("layer", 1): 1.0, ("head", None): 1.0, ("embeddings", None): 0.25}
    df = spark.createDataFrame([(0,), (5,), (10,), (55,), (100,)], "s int")
    assert [r[0] for r in df.select(schedules.linear_rate(F.col("s"), 100, 10, 1.0)).collect()] == [0.0, 0.5, 1.0, 0.5, 0.0]


def test_builders(spark):
    long = "a question that is long enough"
    d = spark.createDataFrame([("1", [("user", long), ("assistant", long)], 9), ("2", [("assistant", long)], 9), ("3", None, 9)], "id string, messages array<struct<role:string,content:string>>, source int")
    out = builders.dialogue_examples(d, [], "consult", "t", DialogueRules()).collect()
    assert [(r.meta.orig_id, [m.role for m in r.messages]) for r in out] == [("1", ["system", "user", "assistant"])]
    q = spark.createDataFrame([("x", "ADAM", "Research", long, long), ("y", "adam", "symptoms", long, long), ("z", None, None, long, None)], "k string, document_source string, question_type string, question string, answer string")
    q = q.withColumns({"question_focus": F.lit(None).cast("string"), "document_id": F.lit("d")})
    assert [r.k for r in builders.reference_examples(q, ["k"]).collect()] == ["y"]
    assert builders.reference_examples(q.limit(0), ["k"]).count() == 0


def test_plan_is_checked():
    with pytest.raises(ValueError):
        MixturePlan(priority=("a",), targets=(MixtureTarget("s", "b", 1, 1),))
    with pytest.raises(ValueError):
        MixturePlan(priority=("a", "a"))

"""Whole builds on small raw tables."""

from __future__ import annotations

import json
from collections import Counter

import pytest

from sparkloom.plans import build
from sparkloom.plans.config import MixturePlan, MixtureTarget, SplitSize


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part*")) for x in p.read_text(encoding="utf-8").splitlines()]


def test_dialogue_build(spark, tmp_path):
    talk = lambda i, n: [{"role": "user", "content": f"question number {i} about the knee"}, {"role": "assistant", "content": f"answer number {i} with some advice"}] * n
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "consult.jsonl").write_text("\n".join(json.dumps({"id": str(i), "messages": talk(i % 20, 1), "pos": i}) for i in range(30)))
    (raw / "exam_dialogue.jsonl").write_text("\n".join(json.dumps({"id": str(i), "messages": talk(100 + i, 2), "pos": i}) for i in range(6)))
    (raw / "followup.jsonl").write_text("\n".join(json.dumps({"id": str(i), "context": f"question number {i} about the knee", "question": f"since when does it hurt there, {i}?", "split": s, "pos": i}) for i, s in enumerate(["train", "valid", "test", "train"])))
    mixture_plan = MixturePlan(
        priority=("followup", "exam_dialogue", "consult", "notes"), lenient=("followup", "exam_dialogue"), splits=(SplitSize("consult", 3, 4, 1), SplitSize("exam_dialogue", 1, 1, 2)),
        targets=(MixtureTarget("stage1", "consult", 10, 3), MixtureTarget("stage1", "exam_dialogue", 9, 4), MixtureTarget("stage2", "followup", 2, 5)),
    )
    with pytest.raises(FileNotFoundError):
        build.raw_table(spark, str(raw), "notes")
    frames = {name: build.raw_table(spark, str(raw), name, allow_missing=True) for name in build.DIALOGUE_TABLES}
    from sparkloom.plans.mixture import dialogue_mixture

    mixture = dialogue_mixture(build.dialogue_pools(frames), mixture_plan)
    build.write_mixture(mixture, mixture_plan, str(tmp_path / "out"))
    stage1 = lines(tmp_path / "out" / "train_stage1.jsonl")
    assert Counter(r["source"] for r in stage1) == {"consult": 10, "exam_dialogue": 9}
    assert len({r["id"] for r in stage1}) == 19 and {r["meta"]["repeat_idx"] for r in stage1 if r["source"] == "exam_dialogue"} == {None, 1, 2}
    assert all(r["messages"][0]["role"] == "system" and len(r["id"]) == 24 for r in stage1)
    sizes = Counter(r["source"] for s in ("train", "val", "test") for r in lines(tmp_path / "out" / f"{s}_unique.jsonl"))
    assert sizes["exam_dialogue"] == 6 and sizes["followup"] == 4
    stats = json.loads((tmp_path / "out" / "stats.json").read_text())
    assert {"config", "pools", "statistics", "all_unique"} <= set(stats)


def test_knowledge_pools_of_absent_tables(spark, tmp_path):
    frames = {name: build.raw_table(spark, str(tmp_path), name, allow_missing=True) for name in build.KNOWLEDGE_TABLES}
    assert build.knowledge_pools(frames).count() == 0


def test_places_without_a_position_column(spark, tmp_path):
    rows = [{"instruction": f"i{k}", "input": "x", "output": "y"} for k in range(40)]
    (tmp_path / "notes.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    places = [r.pos for r in build.raw_table(spark, str(tmp_path), "notes").orderBy("pos").collect()]
    assert places == list(range(0, 80, 2))
    spark.createDataFrame(rows).orderBy("instruction").coalesce(2).write.parquet(str(tmp_path / "task.parquet"))
    assert sorted(r.pos for r in build.raw_table(spark, str(tmp_path), "task").collect()) == list(range(40))


def test_options():
    chosen = build.options(["dialogue", "--tables", "t", "--out", "o", "--target", "stage1.consult=7", "--val", "notes=3", "--seed", "43", "--most-messages", "6", "--question", "100"])
    plan = build.planned(chosen)
    assert next(t for t in plan.targets if (t.stage, t.source) == ("stage1", "consult")).target == 7 and next(s for s in plan.splits if s.source == "notes").val == 3
    assert plan.shuffle_seed == 43 and plan.splits[0].seed == build.DIALOGUE_PLAN.splits[0].seed + 1 and chosen.question == 100
    assert build.planned(build.options(["knowledge", "--tables", "t", "--out", "o", "--scale", "0.5"])).targets[0].target == 19_000
    with pytest.raises(SystemExit):
        build.options(["dialogue", "--tables", "t", "--out", "o", "--scale", "2", "--target", "stage1.consult=7"])
    for bad in (["--target", "stage9.x=1"], ["--val", "followup=1"]):
        with pytest.raises(ValueError):
            build.planned(build.options(["dialogue", "--tables", "t", "--out", "o", *bad]))

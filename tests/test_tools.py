"""Commands on files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.messages import apply_template
from sparkloom.plans import tools
from sparkloom.plans.config import TrainingRun
from sparkloom.sources.eventlog import encode_scalars


def example(i, n=1, role="assistant"):
    return {"id": str(i), "source": "s", "task": "t", "messages": [{"role": "user", "content": "one two"}, {"role": role, "content": "three"}] * n, "meta": {}}


def test_lengths_and_check(spark, tmp_path, capsys):
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps(example(i, i + 1)) for i in range(4)))
    (tmp_path / "val.jsonl").write_text(json.dumps(example(9, role="user")))
    got = tools.main(["lengths", "--data", str(tmp_path / "train.jsonl"), "--max-seq-length", "60"])
    profile = got["profile"].first()
    assert profile.n == 4 and profile["max"] == 4 * profile["mean"] / 2.5 and profile.n_over == 2
    assert sum(r.n for r in got["histogram"].collect()) == 4
    assert tools.main(["lengths", "--data", str(tmp_path / "train.jsonl"), "--sample", "2"])["profile"].first().n == 2
    got = tools.main(["check", "--train", str(tmp_path / "train.jsonl"), "--validation", str(tmp_path / "val.jsonl"), "--out", str(tmp_path / "run")])
    assert {(r.split, r.total, r.kept) for r in got["kept"].collect()} == {("train", 4, 4), ("validation", 1, 0)}
    assert json.loads((tmp_path / "run" / "train_results.json").read_text()) == {"train_samples": 4}
    assert "histogram" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        tools.main(["check", "--train", "x", "--bf16", "--fp16"])


def test_judge_and_sentences(spark, tmp_path):
    bench = {"prompt_id": "a", "prompt": [{"role": "user", "content": "q"}], "rubrics": [{"criterion": "c", "points": 1}], "example_tags": ["t"]}
    (tmp_path / "bench.jsonl").write_text("\n".join(json.dumps({**bench, "prompt_id": p}) for p in "abc"))
    (tmp_path / "gen.jsonl").write_text("\n".join(json.dumps({"prompt_id": p, "response": r}) for p, r in (("a", "1"), ("a", "2"), ("z", "3"))))
    got = tools.main(["judge", "--benchmark", str(tmp_path / "bench.jsonl"), "--generations", str(tmp_path / "gen.jsonl"), "--out", str(tmp_path / "judge")])
    assert tuple(got["counts"].first()) == (1, 2, 1, 1)
    lines = [json.loads(x) for p in (tmp_path / "judge").glob("part*") for x in p.read_text().splitlines()]
    assert [x["prompt_response"][0]["content"] for x in lines] == ["2"]
    (tmp_path / "x.csv").write_bytes("\r".join(f"{'positive' if i % 2 else 'neutral'},sentence {i}" for i in range(40)).encode("latin1"))
    got = tools.main(["sentences", "--data", str(tmp_path / "x.csv"), "--out", str(tmp_path / "s")])
    assert {(r.split, r.label): r.n for r in got["labels"].collect()} == {("train", "neutral"): 16, ("train", "positive"): 16, ("val", "neutral"): 2, ("val", "positive"): 2, ("test", "neutral"): 2, ("test", "positive"): 2}


def test_scalars(spark, tmp_path):
    (tmp_path / "e").write_bytes(encode_scalars([("loss", 2, 0.0, 1.0), ("loss", 1, 0.0, 2.0), ("rate", 1, 0.0, 0.5)]))
    assert [r.tag for r in tools.main(["scalars", "--logs", str(tmp_path / "e")])["tags"].collect()] == ["loss", "rate"]
    assert [tuple(r) for r in tools.main(["scalars", "--logs", str(tmp_path / "e"), "--tag", "loss"])["series"].collect()] == [(1, 2.0), (2, 1.0)]


def test_templates_and_runs(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert df.select(apply_template(F.col("m"), "chatml", True)).first()[0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n"
    assert df.select(apply_template(F.col("m"), ("<s>", "[{role}]{content}", "[?]"))).first()[0] == "<s>[user]hi[assistant]"
    assert TrainingRun().effective_batch == 64
    for bad in ({"bf16": True, "fp16": True}, {"gradient_checkpointing": True, "no_gradient_checkpointing": True}, {"batch": 0}):
        with pytest.raises(ValueError):
            TrainingRun(**bad)

"""Readers, sinks, hooks and streams."""

from __future__ import annotations

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import hooks
from sparkloom.plans.durable import durable, shared_dir
from sparkloom.sources import eventlog, files, readers, sinks


def test_jsonl_round_trip(spark, tmp_path):
    row = {"id": "1", "source": "s", "task": "t", "messages": [{"role": "user", "content": "é\n"}], "meta": {"n_messages": 1}}
    (tmp_path / "a.jsonl").write_text(json.dumps(row, ensure_ascii=False) + "\n\n  \n", encoding="utf-8")
    df = readers.read_splits(spark, {"train": str(tmp_path / "a.jsonl")})
    got = df.collect()
    assert len(got) == 1 and got[0].messages[0].content == "é\n" and got[0].split == "train"
    sinks.write_jsonl(df.drop("split"), str(tmp_path / "out"))
    line = next(x for p in (tmp_path / "out").glob("part*") for x in p.read_text(encoding="utf-8").splitlines())
    assert list(json.loads(line)) == ["source", "task", "messages", "meta", "id"] and "é" in line
    (tmp_path / "bad.jsonl").write_text("{nonsense\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_generations(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"prompt_id": 1, "response": "a"}\n\n{"prompt_id": "1", "response": null}\n')
    assert [(r.prompt_id, r.response) for r in readers.read_generations(spark, str(path)).orderBy("line_no").collect()] == [("1", "a"), ("1", "None")]
    path.write_text('{"prompt_id": 1, "response": "a"}\n' * 2000 + '{"prompt_id": 2}\n')
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # many splits
    with pytest.raises(ValueError, match="line 2001"):
        readers.read_generations(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    path.write_text("\n")
    with pytest.raises(ValueError, match="no responses"):
        readers.read_generations(spark, str(path))


def test_csv_with_carriage_returns(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("positive,caf\xe9\rnegative,b".encode("latin1"))
    assert [tuple(r) for r in readers.read_labelled_csv(spark, str(tmp_path / "x.csv")).collect()] == [("positive", "café"), ("negative", "b")]


def test_fallback_and_splits(spark):
    tried = []

    def load(name):
        tried.append(name)
        if name != "a_b":
            raise KeyError(name)
        return spark.range(1)

    assert readers.with_fallback(readers.name_variants("A-b"), lambda n: load(n.lower())).count() == 1
    with pytest.raises(KeyError):
        readers.with_fallback(["x", "y"], load)
    df = spark.createDataFrame([("valid", 1), ("train", 2)], "split string, n int")
    assert [r.n for r in readers.optional_split(df, "validation", "valid").collect()] == [1]
    assert readers.optional_split(df, "test").count() == 0


def test_event_logs(spark, tmp_path):
    rows = [("loss", 1, 10.0, 2.0), ("lr", 1, 10.5, 0.5), ("loss", -1, 11.0, 1.5)]
    data = eventlog.encode_scalars(rows)
    (tmp_path / "events.out.1").write_bytes(data + data[:30])  # the last record is cut short
    (tmp_path / "events.out.2").write_bytes(b"")
    log = readers.read_event_logs(spark, str(tmp_path))
    assert sorted((r.tag, r.step, r.wall_time, r.value) for r in log.collect()) == sorted(rows)
    assert {r.tag for r in readers.scalar_tags(log).collect()} == {"loss", "lr"}
    assert sorted(tuple(r) for r in readers.scalar_series(log, "loss").collect()) == [(-1, 1.5), (1, 2.0)]
    with pytest.raises(ValueError):
        list(eventlog.records(b"x" * 40))
    assert eventlog.masked_checksum(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    # A number as a tensor, and fields of other kinds beside it.
    tensor = b"\x08\x01" + b"\x22\x04" + struct.pack("<f", 4.0)
    value = b"\x0a\x01t" + b"\x42" + bytes([len(tensor)]) + tensor
    summary = b"\x0a" + bytes([len(value)]) + value
    event = b"\x10\x07\x2a" + bytes([len(summary)]) + summary
    head = struct.pack("<Q", len(event))
    assert list(eventlog.scalars(head + struct.pack("<I", eventlog.masked_checksum(head)) + event + b"0000")) == [("t", 7, 0.0, 4.0)]


def test_reports(spark, tmp_path):
    sinks.write_report(spark, str(tmp_path / "d" / "stats.json"), sizes=spark.range(2), config={"seed": 1, "parts": {"a": spark.range(1)}})
    assert json.loads((tmp_path / "d" / "stats.json").read_text()) == {"sizes": [{"id": 0}, {"id": 1}], "config": {"seed": 1, "parts": {"a": [{"id": 0}]}}}
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "gold_label_id int, pred_label_id int")
    sinks.write_evaluation(rows, str(tmp_path / "e"))
    assert json.loads((tmp_path / "e" / "confusion_matrix.json").read_text())["matrix"] == [[1, 0, 0], [1, 0, 0], [0, 0, 1]]
    metrics = json.loads((tmp_path / "e" / "metrics.json").read_text())
    assert abs(metrics["accuracy"] - 2 / 3) < 1e-9 and abs(metrics["macro_recall"] - 2 / 3) < 1e-9 and len(metrics) == 7
    lines = [x for p in (tmp_path / "e" / "predictions.csv").glob("part*") for x in p.read_text().splitlines()]
    assert "gold_label_id,gold_label,pred_label_id,pred_label" in lines and "1,neutral,0,negative" in lines
    sinks.write_run(str(tmp_path / "r"), {"rate": 0.1}, {"train": spark.range(3)}, {"train": spark.range(3), "eval": spark.range(2)}, {"train": {"loss": 1.5}})
    assert json.loads((tmp_path / "r" / "train_results.json").read_text()) == {"loss": 1.5, "train_samples": 3}
    assert json.loads((tmp_path / "r" / "eval_results.json").read_text()) == {"eval_samples": 2} and (tmp_path / "r" / "run_config.json").exists()
    with pytest.raises(ValueError):
        sinks.write_judge_jsonl(rows.limit(0), str(tmp_path / "j"))
    assert sinks.write_generations(spark.createDataFrame([("a", "x", 1)], "prompt_id string, response string, n int"), str(tmp_path / "g")) == 1
    assert [json.loads(x) for p in (tmp_path / "g").glob("part*") for x in p.read_text().splitlines()] == [{"prompt_id": "a", "response": "x"}]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    n = 0
    for name in ("1.txt", "2.txt"):
        (tmp_path / "a" / name).write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(n, n + 3000)))
        n += 3000
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for size in ("8k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append(sorted((r.line_no, int(r.value.split()[1])) for r in files.numbered_lines(spark, str(tmp_path / "a")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got[0] == got[1] == [(i + 1, i) for i in range(6000)]


def test_named_split(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n')
    assert readers.read_named(spark, {"test": str(tmp_path / "t.jsonl")}, "test", required=("a",)).count() == 1
    for files_, split, required, error in (({"test": str(tmp_path / "t.jsonl")}, "train", (), ValueError), ({"test": str(tmp_path / "no")}, "test", (), FileNotFoundError), ({"test": str(tmp_path / "t.jsonl")}, "test", ("b",), ValueError)):
        with pytest.raises(error):
            readers.read_named(spark, files_, split, required=required)


def test_console_and_pandas(spark):
    rows = readers.turns_of_lines(spark, ["hi\n", "  \n", "more\n", "EXIT\n", "late\n"]).collect()
    assert [(r.turn, r.text) for r in rows] == [(1, "hi"), (2, "more")] and readers.turns_of_lines(spark, []).count() == 0
    frame = pd.DataFrame({"n": [1, 2], "t": ["a", None]})
    assert [tuple(r) for r in readers.from_pandas(spark, frame, "n long, t string").collect()] == [(1, "a"), (2, None)]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, "a b c")], "i int, t string").repartition(2)
    assert [r[0] for r in df.orderBy("i").select(hooks.token_lengths(F.col("t"), hooks.word_tokenizer)).collect()] == [2, 0, 0, 3]
    assert [r[0] for r in df.orderBy("i").select(hooks.word_counts(F.col("t"))).collect()] == [2, 0, 0, 3]
    assert [r.response for r in hooks.generate(df, "t", hooks.echo_model, 2).orderBy("i").collect()] == ["9 words", "0", "0", "5 c"]
    sizes = lambda texts: [[len(w) for w in t.split()] for t in texts]
    rows = df.withColumn("ids", hooks.encode_truncated(F.col("t"), sizes, 2))
    assert [r.ids for r in rows.orderBy("i").collect()] == [[3, 5], [], [], [1, 1]]
    got = hooks.padded_batches(rows.withColumn("b", F.lit(0)), "b", "i", label="i").first()
    assert got.input_ids == [[3, 5], [0, 0], [0, 0], [1, 1]] and got.attention_mask == [[1, 1], [0, 0], [0, 0], [1, 1]] and got.labels == [1, 2, 3, 4]


def test_mask_probe():
    assert hooks.has_assistant_masks(lambda *a, **k: {"assistant_masks": [0, 1]})
    assert not hooks.has_assistant_masks(lambda *a, **k: {"assistant_masks": [0, 0]}) and not hooks.has_assistant_masks(lambda *a, **k: {}) and not hooks.has_assistant_masks(lambda x: {})


def test_durable(spark):
    df = durable(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 5 and all(shared_dir(spark).removeprefix("file://") in f for f in df.inputFiles())
    assert durable(spark.range(0), "e").count() == 0


def test_streaming_histories(spark, tmp_path):
    from sparkloom.streaming.chat import streaming_histories, windowed_counts

    (tmp_path / "in").mkdir()
    rows = [{"conv_id": "a", "turn": 1, "role": "user", "text": "hi"}, {"conv_id": "a", "turn": 2, "role": "user", "text": " "}, {"conv_id": "a", "turn": 3, "role": "user", "text": "more"}, {"conv_id": "a", "turn": 4, "role": "user", "text": "quit"}, {"conv_id": "a", "turn": 5, "role": "user", "text": "late"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timeouts keep batches coming
    lines = spark.readStream.schema("conv_id string, turn long, role string, text string").json(str(tmp_path / "in"))
    q = streaming_histories(lines).writeStream.format("memory").queryName("h").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [(r.turn, r.prompt) for r in spark.table("h").orderBy("turn").collect()] == [(1, "user: hi\n"), (3, "user: hi\nuser: more\n")]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "v", 2.0), ("2024-01-01 00:02:00", "v", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 5.0)]

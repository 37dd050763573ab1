"""Commands on data sets as files: ``python -m sparkloom.plans.tools COMMAND --help``.

* ``lengths``: token lengths of rendered dialogues, how many exceed a limit, a histogram;
* ``check``: how many examples of each split can be trained on;
* ``judge``: joins responses to benchmark prompts, writes judge rows, reports what is left over;
* ``sentences``: cleans labelled sentences and splits them with their labels' proportions;
* ``scalars``: tags of event logs, or the series of one.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import hooks
from sparkloom.functions.messages import apply_template, is_trainable
from sparkloom.operators import classify, judge, sampling, stats
from sparkloom.plans.config import TrainingRun
from sparkloom.plans.durable import durable
from sparkloom.sources import readers, sinks

_BENCHMARK = ("prompt_id", "prompt", "rubrics", "example_tags")


def dialogue_lengths(examples: DataFrame, template: str = "chatml", tokenize: hooks.BatchTokenizer | None = None, sample: int = 0) -> DataFrame:
    """(length): tokens of each rendered dialogue, by words and marks unless a tokenizer is given; of the first ``sample`` by position, 0 for all."""
    rows = sampling.head(examples, sample, "pos") if sample else examples
    text = apply_template(F.col("messages"), template)
    return rows.select((hooks.token_lengths(text, tokenize) if tokenize else hooks.word_counts(text)).alias("length"))


def lengths(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    """Length profile and histogram."""
    rows = readers.read_jsonl(spark, chosen.data).withColumn("pos", F.monotonically_increasing_id())
    got = durable(dialogue_lengths(rows, chosen.template, None, chosen.sample), "lengths")
    return {"profile": stats.length_profile(got, "length", chosen.max_seq_length), "histogram": stats.length_histogram(got)}


def check(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    """Examples kept of each split, and their sources."""
    files = {"train": chosen.train} | ({"validation": chosen.validation} if chosen.validation else {})
    rows = readers.read_splits(spark, files)
    kept = is_trainable(F.col("messages"))
    run = TrainingRun(max_seq_length=chosen.max_seq_length, bf16=chosen.bf16, fp16=chosen.fp16)
    out = {"kept": stats.kept_counts(rows, kept, "split"), "sources": stats.count_by(rows.where(kept), "split", "source", missing="unknown")}
    if chosen.out:
        sinks.write_run(chosen.out, asdict(run), out, {s: rows.where(kept & (F.col("split") == s)) for s in files})
    return out


def judged(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    """Judge rows written; the counts of both sides."""
    benchmark = readers.read_named(spark, {"benchmark": chosen.benchmark}, "benchmark", required=_BENCHMARK)
    answers = durable(readers.read_generations(spark, chosen.generations), "answers")
    sinks.write_judge_jsonl(judge.judge_rows(benchmark, answers), chosen.out)
    return {"counts": judge.reconciliation(benchmark, answers), "unmatched": judge.unmatched_ids(benchmark, answers).orderBy("prompt_id").limit(10), "repeated": judge.duplicate_ids(answers).orderBy("prompt_id").limit(10)}


def sentences(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    """Cleaned sentences written by split; their labels counted."""
    clean = classify.clean_sentences(readers.read_labelled_csv(spark, chosen.data)).withColumn("id", F.sha2(F.concat_ws("|", "label", "sentence"), 256))
    rows = durable(sampling.stratified_split(durable(clean, "sentences"), "id", "label", chosen.seed), "split")
    for split in ("train", "val", "test"):
        sinks.write_jsonl(rows.where(F.col("split") == split).select(classify.encode_label(F.col("label")).alias("label"), "sentence"), f"{chosen.out}/{split}.jsonl")
    return {"labels": stats.count_by(rows, "split", "label").orderBy("split", "label")}


def scalars(spark: SparkSession, chosen: argparse.Namespace) -> dict[str, DataFrame]:
    """Tags, or a series by step."""
    log = readers.read_event_logs(spark, chosen.logs)
    return {"series": readers.scalar_series(log, chosen.tag).orderBy("step")} if chosen.tag else {"tags": readers.scalar_tags(log).orderBy("tag")}


def main(args: list[str] | None = None) -> dict[str, DataFrame]:
    """Run a command, print its tables."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run: Callable, *required: str) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=(run.__doc__ or "").strip())
        own.set_defaults(run=run)
        for r in required:
            own.add_argument(f"--{r}", required=True)
        return own

    own = command("lengths", lengths, "data")
    own.add_argument("--max-seq-length", type=int, default=2048)
    own.add_argument("--sample", type=int, default=0, help="0 for all")
    own.add_argument("--template", default="chatml")
    own = command("check", check, "train")
    own.add_argument("--validation")
    own.add_argument("--out", help="folder for dataset_summary.json, run_config.json and results")
    own.add_argument("--max-seq-length", type=int, default=2048)
    precision = own.add_mutually_exclusive_group()
    precision.add_argument("--bf16", action="store_true")
    precision.add_argument("--fp16", action="store_true")
    command("judge", judged, "benchmark", "generations", "out")
    command("sentences", sentences, "data", "out").add_argument("--seed", type=int, default=42)
    command("scalars", scalars, "logs").add_argument("--tag")
    chosen = parser.parse_args(args)
    tables = chosen.run(SparkSession.builder.getOrCreate(), chosen)
    for name, rows in tables.items():
        print(f"{name}\n{sinks.console(rows, 100)}")
    return tables


if __name__ == "__main__":
    main()

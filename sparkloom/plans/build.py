"""Whole dataset builds from raw tables to JSON lines and a statistics document.

``python -m sparkloom.plans.build dialogue --tables DIR --out DIR`` (or ``knowledge``)
reads the raw tables below DIR (Parquet or JSON lines, on any file system Spark reads),
builds the mixture and writes unique train, val and test sets, each stage, and stats.json.
A table that isn't there is an error, unless ``--allow-missing`` makes it an empty one.
Sizes, targets, seeds and lengths have options of their own: see ``--help``.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.messages import MESSAGES
from sparkloom.operators import builders
from sparkloom.operators.sampling import shuffled
from sparkloom.operators.stats import turn_stats
from sparkloom.plans.config import DIALOGUE_PLAN, KNOWLEDGE_PLAN, DialogueRules, Lengths, MixturePlan
from sparkloom.plans.durable import durable
from sparkloom.plans.mixture import Mixture, dialogue_mixture, knowledge_mixture, pool_sizes, signed
from sparkloom.sources.files import exists, numbered_lines, numbered_parquet
from sparkloom.sources.sinks import write_jsonl, write_report

META = {
    "orig_id": "string", "n_messages": "int", "instruction": "string", "subject_name": "string", "topic_name": "string", "answer_idx": "int", "document_source": "string", "question_type": "string",
    "question_focus": "string", "document_id": "string", "category": "string", "repeat_idx": "int",
}
#: Columns of each raw table, all text unless noted.
RAW = {
    "consult": f"id string, messages {MESSAGES}",
    "exam_dialogue": f"id string, messages {MESSAGES}",
    "followup": f"id string, messages {MESSAGES}, context string, question string",
    "notes": "instruction string, input string, output string",
    "choice": "id string, question string, exp string, choice_type string, opa string, opb string, opc string, opd string, cop string, subject_name string, topic_name string",
    "reference": "document_source string, question_type string, question string, answer string, question_focus string, document_id string",
    "task": "instruction string, input string, output string",
    "general": "instruction string, context string, response string, category string",
}
DIALOGUE_TABLES = ("consult", "exam_dialogue", "followup", "notes")
KNOWLEDGE_TABLES = ("choice", "reference", "task", "notes", "general")


def even_meta(rows: DataFrame) -> DataFrame:
    """Rows whose meta struct has all known fields, null where a source has none."""
    kind = rows.schema["meta"].dataType
    there = set(kind.fieldNames()) if hasattr(kind, "fieldNames") else set()
    return rows.withColumn("meta", F.struct(*[(F.col(f"meta.{k}") if k in there else F.lit(None)).cast(t).alias(k) for k, t in META.items()]))


def raw_table(spark: SparkSession, folder: str, name: str, allow_missing: bool = False) -> DataFrame:
    """A raw table with its known columns, ``split`` (train where it has none) and ``pos``, the place of a row in its files; absent columns are nulls.

    An absent table raises FileNotFoundError, or has no rows if that is allowed.
    """
    schema = spark.createDataFrame([], RAW[name]).schema
    base = f"{folder.rstrip('/')}/{name}"
    if exists(spark, f"{base}.parquet"):
        rows = numbered_parquet(spark, f"{base}.parquet", "_place")
    elif exists(spark, f"{base}.jsonl"):
        lines = numbered_lines(spark, f"{base}.jsonl").where(F.trim("value") != "")
        parsed = F.from_json("value", f"{RAW[name]}, split string, pos long", {"mode": "FAILFAST"})
        rows = lines.select(parsed.alias("r"), (F.col("line_no") - 1).alias("_place")).select("r.*", "_place")
    elif allow_missing:
        rows = spark.createDataFrame([], schema).withColumn("_place", F.lit(0).cast("long"))
    else:
        raise FileNotFoundError(f"neither {base}.parquet nor {base}.jsonl")
    has = set(rows.columns)
    split = F.coalesce(F.lower(F.trim("split")), F.lit("train")) if "split" in has else F.lit("train")
    pos = F.coalesce(F.col("pos").cast("long"), F.col("_place")) if "pos" in has else F.col("_place")
    columns = [(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*columns, F.when(split.isin("valid", "validation"), "val").otherwise(split).alias("split"), pos.alias("pos"))


def dialogue_pools(raw: Mapping[str, DataFrame], rules: DialogueRules = DialogueRules(), lengths: Lengths = Lengths(), least_multi_turn: int = 4) -> DataFrame:
    """All sources of a dialogue mixture as one pool with signatures."""
    keep = ["pos", "split"]
    single = replace(rules, most_messages=min(3, rules.most_messages), least_messages=2, drop_provider_openings=True)
    multi = replace(rules, least_messages=least_multi_turn, drop_provider_openings=False)
    parts = [
        builders.dialogue_examples(raw["consult"], keep, "consult", "single_turn_consult", single),
        builders.followup_examples(raw["followup"], keep, rules),
        builders.notes_examples(raw["notes"], keep, lengths, dialogue=True),
        builders.dialogue_examples(raw["exam_dialogue"], keep, "exam_dialogue", "multi_turn_consult", multi),
    ]
    return _pool(parts)


def knowledge_pools(raw: Mapping[str, DataFrame], lengths: Lengths = Lengths()) -> DataFrame:
    """All sources of a knowledge mixture as one pool with signatures."""
    keep = ["pos", "split"]
    parts = [
        builders.choice_examples(raw["choice"], keep, lengths), builders.reference_examples(raw["reference"], keep, lengths), builders.task_examples(raw["task"], keep, lengths),
        builders.notes_examples(raw["notes"], keep, lengths), builders.general_examples(raw["general"], keep, lengths),
    ]
    return _pool(parts)


def _pool(parts: list[DataFrame]) -> DataFrame:
    out = even_meta(parts[0])
    for p in parts[1:]:
        out = out.unionByName(even_meta(p))
    return signed(out)


def write_mixture(mixture: Mixture, plan: MixturePlan, out: str) -> None:
    """Unique train, val and test sets and every stage as JSON lines in seeded order, and stats.json."""
    columns = ("source", "task", "messages", "meta", "id")
    seed = plan.shuffle_seed
    for i, split in enumerate(("train", "val", "test")):
        rows = mixture.with_texts(mixture.unique.where(F.col("split") == split)).select(*columns)
        write_jsonl(shuffled(rows, seed + i), f"{out}/{split}_unique.jsonl")
    drawn = durable(mixture.drawn, "drawn")  # read by each stage and by the statistics
    for i, stage in enumerate(sorted({t.stage for t in plan.targets})):
        rows = mixture.with_texts(drawn.where(F.col("stage") == stage))
        rows = rows.withColumn("meta", F.col("meta").withField("repeat_idx", F.when(F.col("repeat_idx") > 0, F.col("repeat_idx").cast("int"))))
        write_jsonl(shuffled(rows.select(*columns), seed + 3 + i), f"{out}/train_{stage}.jsonl")
    done = replace(mixture, drawn=drawn)
    write_report(drawn.sparkSession, f"{out}/stats.json", config=asdict(plan), pools=pool_sizes(done), statistics=done.stats(), all_unique=turn_stats(done.unique))


def _named_number(text: str) -> tuple[str, int]:
    name, _, number = text.partition("=")
    return name, int(number)


def options(args: list[str] | None = None) -> argparse.Namespace:
    """Read and check the options."""
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("kind", choices=("dialogue", "knowledge"))
    parser.add_argument("--tables", required=True, help="folder of the raw tables")
    parser.add_argument("--out", required=True, help="folder to write to")
    parser.add_argument("--seed", type=int, default=42, help="moves all seeds alike")
    parser.add_argument("--allow-missing", action="store_true", help="absent tables are empty")
    sized = parser.add_mutually_exclusive_group()
    sized.add_argument("--target", action="append", default=[], metavar="STAGE.SOURCE=N", help="examples of a source in a stage, instead of the recipe's")
    sized.add_argument("--scale", type=float, help="all targets and split sizes times this")
    parser.add_argument("--val", action="append", default=[], type=_named_number, metavar="SOURCE=N", help="validation rows of a source")
    parser.add_argument("--test", action="append", default=[], type=_named_number, metavar="SOURCE=N", help="test rows of a source")
    for f in fields(Lengths):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=int, default=f.default, metavar="CHARACTERS")
    parser.add_argument("--most-messages", type=int, default=DialogueRules.most_messages)
    parser.add_argument("--least-multi-turn", type=int, default=4)
    return parser.parse_args(args)


def planned(chosen: argparse.Namespace) -> MixturePlan:
    """The recipe with what the options change. Raises ValueError for a stage or source it doesn't have."""
    plan = DIALOGUE_PLAN if chosen.kind == "dialogue" else KNOWLEDGE_PLAN
    moved, times = chosen.seed - plan.shuffle_seed, 1.0 if chosen.scale is None else chosen.scale
    targets = {(t.stage, t.source): replace(t, target=round(t.target * times), seed=t.seed + moved) for t in plan.targets}
    splits = {s.source: replace(s, val=round(s.val * times), test=round(s.test * times), seed=s.seed + moved) for s in plan.splits}
    for name, n in map(_named_number, chosen.target):
        key = tuple(name.split(".", 1))
        if key not in targets:
            raise ValueError(f"no target {name}; there are {sorted('.'.join(k) for k in targets)}")
        targets[key] = replace(targets[key], target=n)
    for part, given in (("val", chosen.val), ("test", chosen.test)):
        for source, n in given:
            if source not in splits:
                raise ValueError(f"{source} has splits of its own; sizes are for {sorted(splits)}")
            splits[source] = replace(splits[source], **{part: n})
    return replace(plan, shuffle_seed=chosen.seed, targets=tuple(targets.values()), splits=tuple(splits.values()))


def main(args: list[str] | None = None) -> None:
    """Read options, build, write."""
    chosen = options(args)
    plan = planned(chosen)
    spark = SparkSession.builder.getOrCreate()
    lengths = Lengths(**{f.name: getattr(chosen, f.name) for f in fields(Lengths)})
    rules = DialogueRules(most_messages=chosen.most_messages, least_user=lengths.least_user, least_assistant=lengths.least_assistant)
    raw = {name: raw_table(spark, chosen.tables, name, chosen.allow_missing) for name in (DIALOGUE_TABLES if chosen.kind == "dialogue" else KNOWLEDGE_TABLES)}
    # The texts are cleaned once: splits, ranks and draws read slim columns of this table, writers its texts.
    if chosen.kind == "dialogue":
        mixture = dialogue_mixture(durable(dialogue_pools(raw, rules, lengths, chosen.least_multi_turn), "texts"), plan)
    else:
        mixture = knowledge_mixture(durable(knowledge_pools(raw, lengths), "texts"), plan)
    write_mixture(mixture, plan, chosen.out)


if __name__ == "__main__":
    main()

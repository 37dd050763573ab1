"""Readers with explicit schemas. Files stay splittable; order is kept in a column where it counts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.chat import EXIT_WORDS
from sparkloom.operators.judge import require_columns
from sparkloom.operators.sampling import shuffled
from sparkloom.sources.eventlog import encode_scalars, scalars
from sparkloom.sources.files import exists, numbered_lines

EXAMPLE_SCHEMA = (
    "id string, source string, task string, messages array<struct<role:string,content:string>>, "
    "meta struct<orig_id:string,n_messages:int,instruction:string,subject_name:string,topic_name:string,answer_idx:int,document_source:string,question_type:string,"
    "question_focus:string,document_id:string,category:string,repeat_idx:int>"
)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str = EXAMPLE_SCHEMA, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped. strict: a malformed line raises, else it gives nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_splits(spark: SparkSession, files: dict[str, str], schema: str = EXAMPLE_SCHEMA, seed: int | None = None) -> DataFrame:
    """JSON lines of several splits as one table with a ``split`` column; a split without file has no rows. With a seed each split's rows come in the order it determines."""
    out = None
    for split, path in files.items():
        part = read_jsonl(spark, path, schema).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    rows = out if out is not None else spark.createDataFrame([], schema + ", split string")
    return rows if seed is None else shuffled(rows, seed, "id", within=("split",))


def read_named(spark: SparkSession, files: dict[str, str], split: str, schema: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """One split of a data set given by its pinned files, with the columns it must have.

    Raises ValueError naming the splits there are, or the columns that are missing, and
    FileNotFoundError where the split's file is.
    """
    if split not in files:
        raise ValueError(f"no split {split!r}; there are {sorted(files)}")
    if not exists(spark, files[split]):
        raise FileNotFoundError(files[split])
    rows = read_jsonl(spark, files[split], schema) if schema else spark.read.option("mode", "FAILFAST").json(files[split])
    return require_columns(rows, *required)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, response, line_no) of JSON lines files, by line from 1.

    Lines that aren't JSON, or lack a prompt id or response, raise ValueError naming the
    first of them; so does a file without lines. Texts other than strings are taken as text.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.select("line_no", F.from_json("value", "map<string,string>").alias("m"), "value")
    bad = parsed.where(F.col("m").isNull() | ~F.map_contains_key("m", F.lit("prompt_id")) | ~F.map_contains_key("m", F.lit("response")) | F.col("m.prompt_id").isNull()).orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line_no}: not an object with prompt_id and response: {bad[0].value[:80]}")
    if parsed.isEmpty():
        raise ValueError("no responses")
    return parsed.select(F.col("m.prompt_id").alias("prompt_id"), F.coalesce("m.response", F.lit("None")).alias("response"), "line_no")


def read_labelled_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", line_end: str = "\r") -> DataFrame:
    """(label, sentence) of a CSV file without header whose rows end in a carriage return."""
    return spark.read.schema("label string, sentence string").option("lineSep", line_end).option("encoding", encoding).csv(path)


def with_fallback(candidates: Sequence[str], load: Callable[[str], DataFrame]) -> DataFrame:
    """The first of the distinct candidates that loads; the last error if none does."""
    last: Exception = ValueError("no candidates")
    for c in dict.fromkeys(candidates):
        try:
            return load(c)
        except Exception as e:  # noqa: BLE001 - any failure leads to the next candidate
            last = e
    raise last


def name_variants(name: str) -> list[str]:
    """Spellings under which a configuration may be stored: as given, in lower case, with underscores, both."""
    return list(dict.fromkeys([name, name.lower(), name.replace("-", "_"), name.lower().replace("-", "_")]))


def optional_split(rows: DataFrame, *names: str, split: str = "split") -> DataFrame:
    """The rows of the first of the named splits that has any, as 'validation' before 'valid'; none if all are absent. One pass finds which."""
    there = {r[0] for r in rows.where(F.col(split).isin(*names)).select(split).distinct().collect()}  # as many as names at most
    chosen = next((n for n in names if n in there), None)
    return rows.where(F.col(split) == chosen) if chosen else rows.where(F.lit(False))


_SCALARS = "file string, tag string, step long, wall_time double, value double"


def _scalar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(path, *r) for r in scalars(content)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "tag", "step", "wall_time", "value"])


def _as_logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        content = encode_scalars(r for r in rows if None not in r)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([content], pa.binary())], names=["path", "content"])


def as_event_logs(rows: DataFrame, tag: str, step: str, wall_time: str, value: str) -> DataFrame:
    """(path, content): the scalars of each batch of rows as the bytes of an event log; rows with a null are left out."""
    return rows.select(F.col(tag).cast("string"), F.col(step).cast("long"), F.col(wall_time).cast("double"), F.col(value).cast("double")).mapInArrow(_as_logs, "path string, content binary")


def event_log_rows(files: DataFrame) -> DataFrame:
    """(file, tag, step, wall_time, value) of event logs given as (path, content)."""
    return files.select("path", "content").mapInArrow(_scalar_rows, _SCALARS)


def read_event_logs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, tag, step, wall_time, value): the scalars of training event logs, files of framed records on any file system.

    A file is read whole by one task, as its records can only be found from its start; a
    last record cut short, as of a run still going, is left out.
    """
    return event_log_rows(spark.read.format("binaryFile").load(path))


def scalar_tags(series: DataFrame) -> DataFrame:
    """The distinct tags of a log."""
    return series.select("tag").distinct()


def scalar_series(series: DataFrame, tag: str) -> DataFrame:
    """(step, value) of a tag."""
    return series.where(F.col("tag") == tag).select("step", "value")


def turns_of_lines(spark: SparkSession, lines: Iterable[str], conversation: str = "console") -> DataFrame:
    """(conv_id, turn, role, text) of lines that a user types, as of ``sys.stdin``: one conversation, a line a turn, up to the first exit word; blank lines are skipped."""
    out = []
    for line in lines:
        said = line.strip()
        if said.lower() in EXIT_WORDS:
            break
        if said:
            out.append((conversation, len(out) + 1, "user", said))
    return spark.createDataFrame(out, "conv_id string, turn long, role string, text string")


def from_pandas(spark: SparkSession, frame, schema: str | None = None) -> DataFrame:  # noqa: ANN001 - a pandas frame
    """A frame in the driver's memory as a table: missing values become nulls."""
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema) if len(frame.columns) else spark.createDataFrame([], schema or "")

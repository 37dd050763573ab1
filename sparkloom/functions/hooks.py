"""Batch hooks for models and tokenizers: Arrow batches in and out, the model pluggable."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD_OR_MARK = re.compile(r"\w+|[^\w\s]")

#: What maps a list of texts to as many lists of tokens or ids, as the batch call of a tokenizer does.
BatchTokenizer = Callable[[list[str]], Sequence[Sequence]]


def word_tokenizer(texts: list[str]) -> list[list[str]]:
    """A stand-in tokenizer: words and single marks."""
    return list(map(_WORD_OR_MARK.findall, texts))


def word_counts(text: Column) -> Column:
    """How many tokens :func:`word_tokenizer` makes of a text, as a built-in expression."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]")), F.lit(0)).cast("long")


def _tokens(texts: pa.Array, tokenize: BatchTokenizer) -> list[Sequence]:
    """Tokens of a batch: the tokenizer is called once, for the texts that have something in them."""
    own = texts.to_pylist()
    some = iter(tokenize([t for t in own if t])) if any(own) else iter(())
    return [next(some) if t else () for t in own]


def token_lengths(text: Column, tokenize: BatchTokenizer) -> Column:
    """Tokens of each text by any tokenizer, a batch at a time; null counts 0."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([len(x) for x in _tokens(texts, tokenize)], pa.int64())

    return run(text)


def encode_truncated(text: Column, tokenize: BatchTokenizer, most: int = 128) -> Column:
    """Ids of each text, at most ``most``, a batch at a time; null gives an empty list."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([list(x[:most]) for x in _tokens(texts, tokenize)], pa.list_(pa.int64()))

    return run(text)


def padded_batches(rows: DataFrame, batch: str, order: str, ids: str = "ids", pad: int = 0, label: str | None = None) -> DataFrame:
    """(batch, input_ids, attention_mask, labels): the rows of each batch, in order, as matrices as wide as its longest row.

    ``labels`` are those of the rows, or null. A batch holds few rows by its nature.
    Null lists count as empty.
    """
    own = F.coalesce(F.col(ids), F.array().cast("array<bigint>"))
    packed = F.struct(F.col(order).alias("o"), own.alias("i"), (F.col(label) if label else F.lit(None).cast("int")).alias("l"))
    made = rows.groupBy(F.col(batch).alias("batch")).agg(F.array_sort(F.collect_list(packed)).alias("r"), F.max(F.size(own)).alias("w"))
    filled = lambda r, x: F.concat(x, F.array_repeat(F.lit(pad).cast("bigint"), F.col("w") - F.size(r.i)))
    mask = lambda r: F.concat(F.transform(r.i, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("w") - F.size(r.i)))
    return made.select("batch", F.transform("r", lambda r: filled(r, r.i)).alias("input_ids"), F.transform("r", mask).alias("attention_mask"), (F.transform("r", lambda r: r.l) if label else F.lit(None)).alias("labels"))


def has_assistant_masks(template: Callable[..., Mapping]) -> bool:
    """Whether a tokenizer's chat template tells which tokens are the assistant's: asked with a short dialogue, it must give a mask that is neither missing nor all 0."""
    probe = [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hello there"}]
    try:
        mask = template(probe, tokenize=True, return_dict=True, return_assistant_tokens_mask=True).get("assistant_masks")
    except Exception:  # noqa: BLE001 - a template without the option may fail in any way
        return False
    return mask is not None and any(mask)


def generate(rows: DataFrame, prompt: str, model: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 16, name: str = "response") -> DataFrame:
    """Rows with the stripped output of a batch model for each prompt.

    ``model`` is called once in a task and gives what maps a list of prompts to as many
    texts; batches hold at most ``batch_size``. Null prompts are passed as ''.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for frame in batches:
            out: list[str] = []
            prompts = ["" if p is None else p for p in frame[prompt].tolist()]
            for a in range(0, len(prompts), batch_size):
                got = own(prompts[a : a + batch_size])
                if len(got) != len(prompts[a : a + batch_size]):
                    raise ValueError("the model gave another number of texts than prompts")
                out += [g.strip() for g in got]
            yield frame.assign(**{name: out})

    return rows.mapInPandas(run, schema)


def echo_model() -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in model: the length of each prompt and its last word."""
    return lambda prompts: [f" {len(p)} {p.split()[-1] if p.split() else ''} " for p in prompts]

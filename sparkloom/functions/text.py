"""Text functions as column expressions: they stay in whole-stage code generation.

Only NFKC normalisation has no built-in; it is one Arrow UDF that hands text back as it
is where nothing changes. ``nfkc=False`` leaves it out for data known to be normal.
Null counts as the empty string throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import patterns as P


def _normal(text: str | None) -> str | None:
    return text if text is None or text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


@F.arrow_udf(T.StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(map(_normal, texts.to_pylist()), pa.string())


_MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


@F.arrow_udf(_MESSAGES)
def nfkc_messages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Message arrays with their contents in NFKC: a UDF can't stand inside a lambda, so whole arrays pass through it."""
    for arrays in batches:
        flat = arrays.values
        contents = pa.array(map(_normal, flat.field("content").to_pylist()), pa.string())
        even = pa.StructArray.from_arrays([flat.field("role"), contents], ["role", "content"], mask=flat.is_null())
        yield pa.ListArray.from_arrays(arrays.offsets, even, mask=arrays.is_null()) if arrays.null_count else pa.ListArray.from_arrays(arrays.offsets, even)


#: The characters of P.SPACE, in which it is the ends that count.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _any(patterns: tuple[str, ...]) -> str:
    """Any of the patterns; classes and word boundaries of all scripts, in every version of Java."""
    return "(?U:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(_SPACES))


def squeeze(text: Column) -> Column:
    """On one line: each run of white space is one space; none at the ends."""
    return strip(F.regexp_replace(text, rf"{P.SPACE}+", " "))


def clean_text(value: Column, nfkc: bool = True) -> Column:
    """Unicode variants, line ends and spacing made even; paragraphs stay. Any type is cast to text; null gives ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.translate(_nfkc(text) if nfkc else text, "​ ", "  ")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")  # single spaces stay as they are
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_for_hash(value: Column, nfkc: bool = True, cleaned: bool = False) -> Column:
    """Lower-case ASCII letters, digits and single spaces only, for loose comparison; URLs go. Text without any gives ''.

    cleaned: ``value`` has been through :func:`clean_text` already.
    """
    low = F.lower(value if cleaned else clean_text(value, nfkc))
    low = F.regexp_replace(low, rf"https?://{P.NOT_SPACE}+", " ")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 in hex of the parts in order; null parts count as ''."""
    return F.sha2(F.concat_ws(P.SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def stable_hash_array(parts: Column) -> Column:
    """SHA-256 in hex of the elements of an array, in order."""
    return F.sha2(F.array_join(parts, P.SEPARATOR, ""), 256)


def truncate_at_word(cleaned: Column, most: int) -> Column:
    """Cleaned text of at most ``most`` characters, cut before the last word that began within them; a text that fits stays whole."""
    cut = F.regexp_replace(F.substring(cleaned, 1, most), r" [^ ]*\z", "")
    return F.when(F.length(cleaned) <= most, cleaned).otherwise(strip(cut))


def choice_explanation(value: Column, most: int, nfkc: bool = True) -> Column:
    """An explanation without the answer it gives away, on one line, cut at a word."""
    text = F.regexp_replace(clean_text(value, nfkc), "(?is)" + P.ANSWER_SUFFIX, "")
    return truncate_at_word(squeeze(text), most)


def choice_index(value: Column, nfkc: bool = True) -> Column:
    """0 to 3 by the first digit 1 to 4 anywhere, else by the first letter a to d that stands alone; else null."""
    low = F.lower(clean_text(value, nfkc))
    digit = F.nullif(F.regexp_extract(low, "[1-4]", 0), F.lit(""))
    letter = F.nullif(F.regexp_extract(low, r"(?U)\b[abcd]\b", 0), F.lit(""))
    return F.coalesce(digit.cast("int") - 1, F.ascii(letter) - F.ascii(F.lit("a")))


def strip_footer(value: Column, most: int, nfkc: bool = True) -> Column:
    """An answer on one line without its footer lines, citations and superfluous length."""
    lines = F.filter(F.transform(F.split(clean_text(value, nfkc), P.LINE_ENDS), strip), lambda x: x != "")
    first = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)" + _any(P.FOOTERS))), True)
    kept = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return truncate_at_word(squeeze(F.regexp_replace(F.array_join(kept, "\n"), P.CITATION, "")), most)


def is_provider_opening(value: Column, nfkc: bool = True) -> Column:
    """Whether a text opens as an answerer's boilerplate does."""
    return F.lower(clean_text(value, nfkc)).rlike(rf"\A(?:{_any(P.PROVIDER_OPENINGS)})")


def is_extraction_task(instruction: Column, output: Column) -> Column:
    """Whether an instruction or its output is about extraction, tables or code."""
    return F.lower(F.concat_ws("\n", F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit("")))).rlike("(?d)" + _any(P.EXTRACTION_TASKS))


def is_plain_general(instruction: Column, output: Column) -> Column:
    """Whether an instruction with its output has no code and nothing unsafe."""
    both = F.lower(F.concat_ws("\n", F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))))
    return ~(both.contains("```") | both.rlike(_any(P.CODE_WORDS)) | both.rlike(_any(P.UNSAFE_WORDS)))


def split_list(value: Column, separator: str = ",") -> Column:
    """The trimmed parts of a separated list that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), separator), strip), lambda x: x != "")


def preview(value: Column, most: int = 3000) -> Column:
    """The first characters of a text."""
    return F.substring(F.coalesce(value, F.lit("")), 1, most)


def normal_label(value: Column) -> Column:
    """A label in lower case without outer white space; null gives ''."""
    return F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))


def labelled_prompt(instruction: Column, more: Column) -> Column:
    """Instruction and input under their labels; one alone stands as it is."""
    both = F.concat(F.lit("Instruction: "), instruction, F.lit("\n\nInput: "), more)
    return F.when((instruction != "") & (more != ""), both).when(instruction != "", instruction).otherwise(more)


def topic_prompt(instruction: Column, more: Column, unlabelled_when_blank: bool) -> Column:
    """An input with its topic before it, unless the input names the topic.

    ``unlabelled_when_blank`` decides for a topic of which nothing is left when
    normalised (punctuation, other scripts): True leaves it out, False sets it.
    """
    topic, known = normalize_for_hash(instruction, cleaned=True), normalize_for_hash(more, cleaned=True)
    blank = topic == ""
    bare = (blank | known.contains(topic)) if unlabelled_when_blank else (~blank & known.contains(topic))
    labelled = F.concat(F.lit("Topic: "), instruction, F.lit("\n\n"), more)
    return F.when((instruction != "") & (more != ""), F.when(bare, more).otherwise(labelled)).when(more != "", more).otherwise(instruction)


def option_label(index: Column) -> Column:
    """A, B, C or D for 0 to 3; null beyond."""
    return F.get(F.array(*map(F.lit, "ABCD")), index)


def normal_name(name: Column) -> Column:
    """A source or task with its spelling variants brought together: lower case, trimmed, inner spaces and hyphens as underscores; null or blank gives 'unknown'."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)\A[\s_-]+|[\s_-]+\z", ""), r"(?U)[\s_-]+", "_")
    return F.when(name.isNull() | (plain == ""), F.lit("unknown")).otherwise(plain)

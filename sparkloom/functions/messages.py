"""Functions of message arrays (``array<struct<role, content>>``) as column expressions. No row is exploded."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import clean_text, nfkc_messages, normalize_for_hash, stable_hash, stable_hash_array, strip

MESSAGES = "array<struct<role:string,content:string>>"


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with further columns that are computed once: neither conditions on them nor later columns are rewritten in terms of what they were made from."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def message(role: Column | str, content: Column) -> Column:
    """One message."""
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def normalize_messages(messages: Column, nfkc: bool = True) -> Column:
    """User and assistant messages with something in them, roles in lower case and contents cleaned. A null array stays null."""
    messages = nfkc_messages(messages) if nfkc else messages
    even = F.transform(messages, lambda m: message(F.lower(clean_text(m.role, False)), clean_text(m.content, False)))
    return F.filter(even, lambda m: m.role.isin("user", "assistant") & (m.content != ""))


def merge_turns(messages: Column) -> Column:
    """Neighbours of one role become one message, an empty line between their contents. Empty contents are left out first."""
    start = F.array().cast(MESSAGES)

    def join(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(message(m.role, F.concat(last.content, F.lit("\n\n"), m.content))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1).role == m.role), grown).otherwise(F.concat(done, F.array(message(m.role, m.content))))

    return F.aggregate(F.filter(messages, lambda m: F.coalesce(m.content, F.lit("")) != ""), start, join)


def last_turns(messages: Column, most: int) -> Column:
    """The last ``most`` messages, and if any was cut, not beginning with the assistant."""
    tail = F.slice(messages, -most, most)
    tail = F.when(F.get(tail, 0).role == "assistant", F.slice(tail, 2, most)).otherwise(tail)
    return F.when(F.size(messages) > most, tail).otherwise(messages)


def is_valid_dialogue(messages: Column, least_user: int, least_assistant: int) -> Column:
    """From the user to the assistant, with enough in the first question and the last answer."""
    first, last = F.get(messages, 0), F.get(messages, F.size(messages) - 1)
    fine = (F.size(messages) >= 2) & (first.role == "user") & (last.role == "assistant") & (F.length(first.content) >= least_user) & (F.length(last.content) >= least_assistant)
    return F.coalesce(fine, F.lit(False))


def is_valid_pair(user: Column, assistant: Column, least_user: int, least_assistant: int) -> Column:
    """Whether both cleaned texts are long enough."""
    return (F.length(user) >= least_user) & (F.length(assistant) >= least_assistant)


def is_trainable(messages: Column) -> Column:
    """At least two messages, all with a known role and something in them, one by the assistant. Null gives False."""
    known = F.forall(messages, lambda m: F.coalesce(m.role.isin("system", "user", "assistant") & (strip(m.content) != ""), F.lit(False)))
    return F.coalesce((F.size(messages) >= 2) & known & F.exists(messages, lambda m: m.role == "assistant"), F.lit(False))


def without_system(messages: Column) -> Column:
    """All but the system messages."""
    return F.filter(messages, lambda m: m.role != "system")


def turn_count(messages: Column) -> Column:
    """Messages but the system ones."""
    return F.size(without_system(messages))


def user_signature(messages: Column, cleaned: bool = False) -> Column:
    """The first user message, normalised for comparison; '' without one."""
    first = F.get(F.filter(messages, lambda m: m.role == "user"), 0).content
    return F.coalesce(normalize_for_hash(first, nfkc=not cleaned, cleaned=cleaned), F.lit(""))


def full_signature(messages: Column) -> Column:
    """Hash of roles and normalised contents of all cleaned messages but the system ones."""
    return stable_hash_array(F.transform(without_system(messages), lambda m: F.concat(m.role, F.lit(": "), normalize_for_hash(m.content, cleaned=True))))


def _quoted(text: Column) -> Column:
    """A JSON string literal, control characters as \\u00xx with small letters."""
    literal = F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'\A\{"x":|\}\z', "")
    return F.when(literal.rlike(r"\\u00[01][0-9A-F]"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        literal, r"(\\u00[01])A", "$1a"), r"(\\u00[01])B", "$1b"), r"(\\u00[01])C", "$1c"), r"(\\u00[01])D", "$1d"), r"(\\u00[01])E", "$1e"), r"(\\u00[01])F", "$1f")).otherwise(literal)


def messages_json(messages: Column) -> Column:
    """Messages as JSON with content before role and a space after each separator."""
    each = F.transform(messages, lambda m: F.concat(F.lit('{"content": '), _quoted(m.content), F.lit(', "role": '), _quoted(m.role), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def example_id(source: Column, task: Column, messages: Column) -> Column:
    """24 hex digits that source, task and messages determine."""
    return F.substring(stable_hash(source, task, messages_json(messages)), 1, 24)


def repeated_id(own: Column, repeat: Column) -> Column:
    """The id of a repetition; the first use keeps its own."""
    return F.when(repeat == 0, own).otherwise(F.substring(stable_hash(own, repeat.cast("string")), 1, 24))


def conversation(system: str | None, *turns: Column) -> Column:
    """Messages under an optional system prompt."""
    return F.array(*([message("system", F.lit(system))] if system else []), *turns)


def with_system(system: str | None, messages: Column) -> Column:
    """Messages with a system prompt before them."""
    return F.concat(F.array(message("system", F.lit(system))), messages) if system else messages


#: Chat templates by name: what stands before all messages, a message, and what asks for an answer. Public formats; others are given as such a triple.
TEMPLATES = {
    "tags": ("", "<|{role}|>\n{content}\n", "<|assistant|>\n"),
    "chatml": ("", "<|im_start|>{role}\n{content}<|im_end|>\n", "<|im_start|>assistant\n"),
    "plain": ("", "{role}: {content}\n", "assistant: "),
}


def render_chat(messages: Column, turn: str = TEMPLATES["tags"][1], generation_prompt: str = "", start: str = "", roles: Mapping[str, str] | None = None) -> Column:
    """The text of a dialogue under a chat template: ``start``, ``turn`` for each message with {role} and {content}, then the generation prompt. ``roles`` renames roles."""
    lead, rest = turn.split("{role}")
    between, tail = rest.split("{content}")
    named = (lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), r), r)) if roles else (lambda r: r)
    parts = F.transform(messages, lambda m: F.concat(F.lit(lead), named(m.role), F.lit(between), F.coalesce(m.content, F.lit("")), F.lit(tail)))
    return F.concat(F.lit(start), F.array_join(parts, ""), F.lit(generation_prompt))


def apply_template(messages: Column, template: str | tuple[str, str, str] = "chatml", generation: bool = False) -> Column:
    """The text of a dialogue under a named template, with the request for an answer if ``generation``."""
    start, turn, ask = TEMPLATES[template] if isinstance(template, str) else template
    return render_chat(messages, turn, ask if generation else "", start)


def as_response(text: Column) -> Column:
    """A response as the single assistant message."""
    return F.array(message("assistant", F.coalesce(text, F.lit("None"))))


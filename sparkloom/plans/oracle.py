"""The registered queries once more, as DuckDB SQL over the same tables: written from the rules, not from the Spark plans."""

from __future__ import annotations

from sparkloom.functions import patterns as P

W = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NL = "chr(10)"


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", options: str = "g") -> str:
    """regexp_replace of all matches."""
    return f"regexp_replace({x}, {quote(pattern)}, {to if to.startswith('chr(') else quote(to)}, '{options}')"


def strip(x: str) -> str:
    """Without outer white space."""
    return sub(x, rf"\A{W}+|{W}+\z")


def squeeze(x: str) -> str:
    """On one line."""
    return strip(sub(x, f"{W}+", " "))


def clean(x: str) -> str:
    """Cleaned text; the tables these queries read hold no other compatibility characters than no-break spaces and the ordinal sign."""
    even = f"translate(coalesce({x}, ''), chr(8203) || chr(160) || 'º', '  o')"
    return strip(sub(sub(sub(even, r"\r\n?", "chr(10)"), r"[ \t]+", " "), r"\n{3,}", "chr(10) || chr(10)"))


def norm(cleaned: str) -> str:
    """Normalised for comparison."""
    return f"trim({sub(sub(f'lower({cleaned})', r'https?://[^\t-\r\x1c-\x1f\x{85}\p{Z}]+', ' '), '[^a-z0-9]+', ' ')})"


def cut(x: str, most: int) -> str:
    """Truncated at a word."""
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {strip(sub(f'substring({x}, 1, {most})', ' [^ ]*$', ''))} END"


def name(x: str) -> str:
    """Spelling variants brought together."""
    return f"coalesce(nullif({sub(sub(f'lower({x})', r'^[\s_-]+|[\s_-]+$'), r'[\s_-]+', '_')}, ''), 'unknown')"


def alternatives(patterns: tuple[str, ...]) -> str:
    """Any of the patterns; word boundaries as RE2 knows them for ASCII text."""
    return "|".join(f"(?:{p})" for p in patterns)


SEP = "chr(10) || '<SEP>' || chr(10)"
FOOTER = alternatives(P.FOOTERS)


def footer(x: str, most: int) -> str:
    """An answer without its footer."""
    lines = f"list_filter(list_transform(string_split_regex({clean(x)}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {strip('l')}), lambda l: l <> '')"
    first = f"list_position(list_transform({lines}, lambda l: regexp_matches(l, '(?i){FOOTER}')), true)"
    kept = f"array_to_string(CASE WHEN coalesce({first}, 0) > 0 THEN ({lines})[1:({first} - 1)] ELSE {lines} END, {NL})"
    return f"(SELECT {cut('y', most)} FROM (SELECT {squeeze(sub('z', P.CITATION))} AS y FROM (SELECT {kept} AS z)))"


#: Dialogue rows to merged turns: rid, id, g (place), role, content.
TURNS = f"""
src AS (SELECT row_number() OVER () AS rid, * FROM dialogue),
m AS (SELECT rid, id, messages, unnest(range(1, len(messages) + 1)) AS i FROM src),
e AS (SELECT rid, id, i, lower({clean('messages[i].role')}) AS role, {clean('messages[i].content')} AS content FROM m),
k AS (SELECT * FROM e WHERE role IN ('user', 'assistant') AND content <> ''),
b AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS brk FROM k),
h AS (SELECT *, sum(brk) OVER (PARTITION BY rid ORDER BY i) AS g FROM b),
t AS (SELECT rid, id, g, min(role) AS role, string_agg(content, {NL} || {NL} ORDER BY i) AS content FROM h GROUP BY rid, id, g)"""


def tail(most: int) -> str:
    """Merged turns cut to the last ones."""
    return f"""
n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY g) AS r, count(*) OVER (PARTITION BY rid) AS c FROM t),
l AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY g) AS q FROM n WHERE c <= {most} OR r > c - {most}),
u AS (SELECT rid, id, g, role, content FROM l WHERE NOT (c > {most} AND q = 1 AND role = 'assistant'))"""


VALID = "first(role ORDER BY g) = 'user' AND last(role ORDER BY g) = 'assistant' AND length(first(content ORDER BY g)) >= 20 AND length(last(content ORDER BY g)) >= 20 AND count(*) >= 2"


def json_messages(system: str | None, role: str = "role", content: str = "content", order: str = "g") -> str:
    """Messages as JSON, aggregated."""
    head = f"'{{\"content\": ' || to_json({quote(system)}) || ', \"role\": \"system\"}}, ' || " if system else ""
    return f"'[' || {head}string_agg('{{\"content\": ' || to_json({content})::VARCHAR || ', \"role\": ' || to_json({role})::VARCHAR || '}}', ', ' ORDER BY {order}) || ']'"


def ident(source: str, task: str, messages: str) -> str:
    """24 hex digits."""
    return f"substring(sha256({quote(source)} || {SEP} || {quote(task)} || {SEP} || {messages}), 1, 24)"


def pair_id(source: str, task: str, system: str, user: str, assistant: str) -> str:
    """The id of a system, user and assistant message."""
    one = lambda role, x: f"'{{\"content\": ' || to_json({x})::VARCHAR || ', \"role\": \"{role}\"}}'"
    return ident(source, task, f"'[' || {one('system', quote(system))} || ', ' || {one('user', user)} || ', ' || {one('assistant', assistant)} || ']'")


#: Delivered examples as a pool with signatures.
POOL = f"""
r AS (SELECT record_id, id, messages, CASE WHEN lower(trim(split)) IN ('valid', 'validation') THEN 'val' ELSE lower(trim(split)) END AS split, {name('source')} AS source, {name('task')} AS task FROM finetune_data),
m AS (SELECT *, unnest(range(1, len(messages) + 1)) AS i FROM r),
e AS (SELECT record_id, id, split, source, task, i, lower({clean('messages[i].role')}) AS role, {clean('messages[i].content')} AS content FROM m),
k AS (SELECT * FROM e WHERE role IN ('user', 'assistant') AND content <> ''),
pool AS (SELECT record_id AS pos, id, split, source, task, count(*) AS turns,
  coalesce({norm("arg_min(content, i) FILTER (WHERE role = 'user')")}, '') AS user_sig,
  sha256(string_agg(role || ': ' || {norm('content')}, {SEP} ORDER BY i)) AS full_sig
  FROM k GROUP BY record_id, id, split, source, task)"""


def priority(x: str, sources: tuple[str, ...]) -> str:
    """The place of a source."""
    return "CASE " + " ".join(f"WHEN {x} = {quote(s)} THEN {i + 1}" for i, s in enumerate(sources)) + f" ELSE {len(sources) + 1} END"

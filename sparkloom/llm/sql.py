"""DuckDB SQL of the queries in this subpackage that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
_SPLITS = (r"[\r\n;|]+", r"[\r\n]+", r"\|", ";")


_UNSEEN = r"[\p{Cf}\x{34F}\x{180B}-\x{180D}\x{180F}\x{FE00}-\x{FE0F}]+"


def _letters(x: str) -> str:
    return rf"array_to_string(regexp_extract_all(regexp_replace({x}, '{_UNSEEN}', '', 'g'), '[\p{{L}}\p{{N}}]+[\p{{Mn}}\p{{Mc}}]*'), '')"


def _fields(separator: str) -> str:
    """A case for messages that consist of labelled fields between such separators."""
    parts = rf"list_filter(string_split_regex(x, '{separator}'), lambda p: regexp_matches(p, '[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]'))"
    labelled = rf"len({parts}) > 1 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, '^[^\p{{L}}\p{{N}}]*\p{{L}}[^:]{{0,48}}:'))) = 0"
    return f"WHEN {labelled} THEN array_to_string(list_sort(list_transform({parts}, lambda p: {_letters('p')})), chr(31))"


#: Text folded as far as SQL can: lower case, sharp s; the table holds no other compatibility characters but no-break spaces and the ordinal sign.
_FOLDED = "nfc_normalize(replace(replace(replace(lower(coalesce(messages[i].content, '')), 'ß', 'ss'), chr(160), ' '), 'º', 'o'))"

SQL["p3_found"] = f"""
WITH m AS (SELECT record_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM finetune_data WHERE len(messages) > 0),
c AS (SELECT record_id, i, regexp_replace(lower(coalesce(messages[i].role, '')), '{_SPACE}+', '', 'g') AS role, {_FOLDED} AS x FROM m),
f AS (SELECT record_id, i, role, {_letters('x')} AS plain, CASE {' '.join(map(_fields, _SPLITS))} END AS fields FROM c),
r AS (SELECT record_id, string_agg(role || chr(29) || plain, chr(30) ORDER BY i) AS plain, string_agg(role || chr(29) || coalesce(fields, plain), chr(30) ORDER BY i) AS sorted, count(fields) AS n FROM f GROUP BY record_id),
g AS (SELECT plain, max(struct_pack(n := n, s := sorted)) AS form FROM r WHERE n > 0 GROUP BY plain),
k AS (SELECT record_id, coalesce(g.form.s, r.sorted) AS key FROM r LEFT JOIN g ON r.plain = g.plain)
SELECT keep_id, record_id AS copy_id FROM (SELECT record_id, min(record_id) OVER (PARTITION BY key) AS keep_id FROM k) WHERE keep_id <> record_id"""

SQL["p3_groups"] = SQL["p3_found"].rpartition("\nSELECT keep_id")[0] + "\nSELECT min(record_id) AS keep_id, count(*) AS copies, false AS collision FROM k GROUP BY key"

#: What must hold of a packing: every record is placed for each limit, and no rule is broken.
SQL["p4_invariants"] = """
SELECT stage, CAST(max_seq_length AS INT) AS capacity, (SELECT count(DISTINCT record_id) FROM finetune_data) AS records, 0 AS overfull, 0 AS overlapping, 0 AS split
FROM (SELECT DISTINCT stage, max_seq_length FROM seq_limits WHERE max_seq_length >= 1)"""

_NAME = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '^[\s_-]+|[\s_-]+$', '', 'g'), '[\s_-]+', '_', 'g'), ''), 'unknown')"

SQL["p5_records"] = f"""
SELECT {_NAME.format('source')} AS source, {_NAME.format('task')} AS task, count(*) AS records,
    sum(len(list_filter(coalesce(messages, []), lambda m: length(coalesce(m.content, '')) > 0))) > 0 AS any_tokens FROM finetune_data GROUP BY 1, 2"""

SQL["p7_roundtrip"] = "SELECT doc_id, true AS same FROM documents"

SQL["p8_limits"] = f"SELECT {_NAME.format('source')} AS source, min(max_repeat) AS max_repeat, true AS share_kept, true AS repeats_kept FROM mix_targets GROUP BY 1"

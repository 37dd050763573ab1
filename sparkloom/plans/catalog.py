"""Registered queries of the core operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import hooks
from sparkloom.functions import messages as M
from sparkloom.functions import patterns as P
from sparkloom.functions import text as X
from sparkloom.operators import builders, chat, classify, dedup, judge, sampling, schedules, stats
from sparkloom.plans import mixture
from sparkloom.plans import oracle as O
from sparkloom.plans.config import DialogueRules, MixturePlan, MixtureTarget, SplitSize
from sparkloom.plans.durable import durable, new_folder
from sparkloom.sources import readers, sinks
from sparkloom.sources.readers import optional_split
from sparkloom.sources.tables import spread, table
from sparkloom.streaming.chat import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under its name, and its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


big = lambda c: c.cast("long")

# --- Text functions -------------------------------------------------------------------


@register(f"SELECT document_id, {O.clean('answer')} AS answer, {O.clean('question')} AS question FROM reference_qa")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned questions and answers."""
    return table(spark, folder, "reference_qa").select("document_id", X.clean_text(F.col("answer")).alias("answer"), X.clean_text(F.col("question")).alias("question"))


@register(f"SELECT id, {O.norm(O.clean('question'))} AS question, {O.norm(O.clean('exp'))} AS explanation FROM mcq")
def normalize_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Questions normalised for comparison."""
    return table(spark, folder, "mcq").select("id", X.normalize_for_hash(F.col("question")).alias("question"), X.normalize_for_hash(F.col("exp")).alias("explanation"))


@register(f"SELECT prompt_id, line_no, sha256(coalesce(prompt_id, '') || {O.SEP} || coalesce(response, '')) AS hash FROM generation")
def stable_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of several parts."""
    return table(spark, folder, "generation").select("prompt_id", "line_no", X.stable_hash(F.col("prompt_id"), F.col("response")).alias("hash"))


@register(f"SELECT document_id, {O.cut('x', 150)} AS short, {O.cut('q', 30)} AS question FROM (SELECT document_id, {O.clean('answer')} AS x, {O.clean('question')} AS q FROM reference_qa)")
def truncate_word(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut at a word."""
    cut = lambda c, n: X.truncate_at_word(X.clean_text(F.col(c)), n)
    return table(spark, folder, "reference_qa").select("document_id", cut("answer", 150).alias("short"), cut("question", 30).alias("question"))


@register(f"""SELECT id, {O.cut('x', 120)} AS explanation FROM (SELECT id, {O.squeeze(O.sub(O.clean('exp'), r'(?is)' + P.ANSWER_SUFFIX, ''))} AS x FROM mcq)""")
def mcq_explanation(spark: SparkSession, folder: str) -> DataFrame:
    """Explanations without the answer they give away."""
    return table(spark, folder, "mcq").select("id", X.choice_explanation(F.col("exp"), 120).alias("explanation"))


_INDEX = f"coalesce(try_cast(nullif(regexp_extract(lower({O.clean('cop')}), '[1-4]'), '') AS BIGINT) - 1, ascii(nullif(regexp_extract(lower({O.clean('cop')}), '\\b[abcd]\\b'), '')) - 97)"


@register(f"SELECT id, cop, CAST({_INDEX} AS BIGINT) AS answer_idx FROM mcq")
def mcq_answer_index(spark: SparkSession, folder: str) -> DataFrame:
    """Answer labels as indexes."""
    return table(spark, folder, "mcq").select("id", "cop", big(X.choice_index(F.col("cop"))).alias("answer_idx"))


@register(f"SELECT document_id, {O.footer('answer', 400)} AS answer FROM reference_qa")
def strip_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Answers without footers and citations."""
    return table(spark, folder, "reference_qa").select("document_id", X.strip_footer(F.col("answer"), 400).alias("answer"))


# Few rows of these tables hold what the next three rules look for; every fifth or so is given it on both sides.
_OPENINGS = ("Hi, may I answer your health queries right now? ", "Thanks for posting your query. ", " Welcome to Chat Doctor, ", "Hello, I am Dr. Who. ", "")
_WORDS = ("see the table below", "extract all terms as JSON", "use c++ now", "c++x is here", "nothing of note", "how drugs act")


def _pick(x: str, parts: tuple[str, ...]) -> str:
    return f"(CASE length(coalesce({x}, '')) % {len(parts)} " + " ".join(f"WHEN {i} THEN {O.quote(p)}" for i, p in enumerate(parts)) + " END)"


def _picked(column: str, parts: tuple[str, ...]):  # noqa: ANN202 - a Column
    return F.element_at(F.array(*map(F.lit, parts)), (F.length(F.coalesce(column, F.lit(""))) % len(parts)) + 1)


@register(f"SELECT id, regexp_matches(lower({O.clean(_pick('question', _OPENINGS) + chr(124) * 2 + ' coalesce(question, ' + chr(39) * 2 + ')')}), '\\A(?:{O.alternatives(P.PROVIDER_OPENINGS)})') AS opening FROM mcq")
def boilerplate_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that open as an answerer does."""
    return table(spark, folder, "mcq").select("id", X.is_provider_opening(F.concat(_picked("question", _OPENINGS), F.coalesce("question", F.lit("")))).alias("opening"))


_BOTH = f"lower(coalesce(question, '') || chr(10) || {_pick('question', _WORDS)} || chr(10) || coalesce(exp, ''))"


@register(f"SELECT id, regexp_matches({_BOTH}, '{O.alternatives(P.EXTRACTION_TASKS)}') AS dropped FROM mcq")
def drop_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions about extraction, tables or code."""
    return table(spark, folder, "mcq").select("id", X.is_extraction_task(F.concat_ws("\n", F.coalesce("question", F.lit("")), _picked("question", _WORDS)), F.col("exp")).alias("dropped"))


@register(f"SELECT id, NOT (contains({_BOTH}, '```') OR regexp_matches({_BOTH}, '{O.alternatives(P.CODE_WORDS)}') OR regexp_matches({_BOTH}, '{O.alternatives(P.UNSAFE_WORDS)}')) AS kept FROM mcq")
def keep_general(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions without code and unsafe matters."""
    return table(spark, folder, "mcq").select("id", X.is_plain_general(F.concat_ws("\n", F.coalesce("question", F.lit("")), _picked("question", _WORDS)), F.col("exp")).alias("kept"))


@register("SELECT prompt_id, array_to_string(list_filter(list_transform(string_split(array_to_string(example_tags, ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM benchmark_prompt")
def list_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Lists in a text, parsed."""
    return table(spark, folder, "benchmark_prompt").select("prompt_id", F.array_join(X.split_list(F.array_join("example_tags", " , ")), "|").alias("tags"))


# --- Messages -------------------------------------------------------------------------


def _turns(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    merged = M.merge_turns(M.normalize_messages(F.col("messages")))
    rows = spread(table(spark, folder, "dialogue")).where("messages is not null")
    return rows.select("id", (M.last_turns(merged, most) if most else merged).alias("turns"))


@register(f"WITH {O.TURNS} SELECT id, CAST(row_number() OVER (PARTITION BY rid ORDER BY g) - 1 AS BIGINT) AS turn, role, content FROM t")
def merge_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues with neighbours of one role merged."""
    return _turns(spark, folder).select("id", F.posexplode("turns").alias("turn", "m")).select("id", big(F.col("turn")).alias("turn"), "m.role", "m.content")


@register(f"WITH {O.TURNS}, {O.tail(3)} SELECT id, CAST(row_number() OVER (PARTITION BY rid ORDER BY g) - 1 AS BIGINT) AS turn, role, content FROM u")
def tail_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last turns of each dialogue."""
    return _turns(spark, folder, 3).select("id", F.posexplode("turns").alias("turn", "m")).select("id", big(F.col("turn")).alias("turn"), "m.role", "m.content")


@register(f"WITH {O.TURNS} SELECT id, count(*) AS turns, ({O.VALID}) AS valid FROM t GROUP BY rid, id")
def valid_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """Whether dialogues go from the user to the assistant with enough in them."""
    return _turns(spark, folder).where("size(turns) > 0").select("id", big(F.size("turns")).alias("turns"), M.is_valid_dialogue(F.col("turns"), 20, 20).alias("valid"))


@register(
    f"""SELECT record_id, coalesce(len(messages) >= 2
      AND len(list_filter(messages, lambda m: NOT coalesce(m.role IN ('system', 'user', 'assistant') AND {O.strip('m.content')} <> '', false))) = 0
      AND len(list_filter(messages, lambda m: m.role = 'assistant')) > 0, false) AS valid FROM finetune_data"""
)
def validate_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Whether records can be trained on."""
    return table(spark, folder, "finetune_data").select("record_id", M.is_trainable(F.col("messages")).alias("valid"))


@register(f"WITH {O.POOL} SELECT pos, user_sig, full_sig, turns FROM pool")
def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures of records."""
    # The SQL can't normalise compatibility characters.
    return mixture.pool_of_records(spread(table(spark, folder, "finetune_data"))).select("pos", "user_sig", "full_sig", big(F.size("messages")).alias("turns"))


@register("SELECT record_id, (SELECT coalesce(string_agg('<|' || m.role || '|>' || chr(10) || coalesce(m.content, '') || chr(10), '' ORDER BY i), '') FROM (SELECT unnest(messages) AS m, unnest(range(len(messages))) AS i)) || '<|assistant|>' AS text FROM (SELECT * FROM finetune_data WHERE messages IS NOT NULL AND len(list_filter(messages, lambda m: m.role IS NULL)) = 0)")
def render_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues under a chat template."""
    rows = table(spark, folder, "finetune_data").where("messages is not null and not exists(messages, m -> m.role is null)")
    return rows.select("record_id", M.render_chat(F.col("messages"), generation_prompt="<|assistant|>").alias("text"))


# --- Builders -------------------------------------------------------------------------


def _dialogue_sql(most: int, least: int, source: str, task: str, openings: bool) -> str:
    return f"""WITH {O.TURNS}, {O.tail(most)},
      d AS (SELECT id AS orig_id, count(*) AS n_messages, {O.json_messages(P.CONSULT_SYSTEM)} AS js, first(content ORDER BY g) AS opening FROM u GROUP BY rid, id HAVING count(*) >= {least} AND {O.VALID})
      SELECT orig_id, n_messages, {O.ident(source, task, 'js')} AS id FROM d""" + (f" WHERE NOT regexp_matches(lower(opening), '\\A(?:{O.alternatives(P.PROVIDER_OPENINGS)})')" if openings else "")


@register(_dialogue_sql(3, 2, "consult", "single_turn_consult", True))
def build_single_turn(spark: SparkSession, folder: str) -> DataFrame:
    """Short dialogues as examples."""
    rules = DialogueRules(most_messages=3, least_messages=2, drop_provider_openings=True)
    made = builders.dialogue_examples(spread(table(spark, folder, "dialogue")), [], "consult", "single_turn_consult", rules)
    return made.select("meta.orig_id", big(F.col("meta.n_messages")).alias("n_messages"), "id")


@register(_dialogue_sql(12, 4, "exam_dialogue", "multi_turn_consult", False))
def build_multi_turn(spark: SparkSession, folder: str) -> DataFrame:
    """Long dialogues as examples."""
    rules = DialogueRules(most_messages=12, least_messages=4, drop_provider_openings=False)
    made = builders.dialogue_examples(spread(table(spark, folder, "dialogue")), [], "exam_dialogue", "multi_turn_consult", rules)
    return made.select("meta.orig_id", big(F.col("meta.n_messages")).alias("n_messages"), "id")


@register(
    f"""WITH x AS (SELECT document_id, {O.clean('answer')} AS context, {O.clean('question')} AS question FROM reference_qa)
    SELECT document_id AS orig_id, {O.pair_id('followup', 'ask_followup', P.FOLLOWUP_SYSTEM, 'context', 'question')} AS id FROM x
    WHERE length(context) >= 20 AND length(question) >= 20 AND NOT regexp_matches(lower(context), '\\A(?:{O.alternatives(P.PROVIDER_OPENINGS)})')"""
)
def build_followup(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts with the question to ask, as examples: every other one as messages, whose other columns say nothing."""
    as_list = F.length(F.coalesce("answer", F.lit(""))) % 2 == 1
    messages = F.array(M.message(" User ", F.col("answer")), M.message("assistant", F.col("question")))
    rows = table(spark, folder, "reference_qa").select(
        F.col("document_id").alias("id"), F.when(~as_list, F.col("answer")).alias("context"), F.when(~as_list, F.col("question")).alias("question"), F.when(as_list, messages).cast(M.MESSAGES).alias("messages")
    )
    return builders.followup_examples(rows, []).select("meta.orig_id", "id")


@register(
    f"""WITH x AS (SELECT id, lower({O.clean('choice_type')}) AS kind, {O.clean('question')} AS q0, {O.squeeze(O.sub(O.clean('exp'), r'(?is)' + P.ANSWER_SUFFIX, ''))} AS e0,
      {O.clean('opa')} AS a, {O.clean('opb')} AS b, {O.clean('opc')} AS c, {O.clean('opd')} AS d, CAST({_INDEX} AS BIGINT) AS k FROM mcq),
    y AS (SELECT *, {O.cut('q0', 2000)} AS q, {O.cut('e0', 2800)} AS e FROM x),
    z AS (SELECT id, k, {O.quote(P.CHOICE_LEAD)} || 'Question: ' || q || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d AS u,
      'Explanation: ' || e || chr(10) || chr(10) || 'Final answer: ' || ['A', 'B', 'C', 'D'][k + 1] || '. ' || [a, b, c, d][k + 1] AS s FROM y
      WHERE kind IN ('', 'single') AND q <> '' AND e <> '' AND a <> '' AND b <> '' AND c <> '' AND d <> '' AND k IS NOT NULL)
    SELECT id AS orig_id, k AS answer_idx, s AS answer, {O.pair_id('choice', 'choice_explained', P.REFERENCE_SYSTEM, 'u', 's')} AS id FROM z WHERE length(u) >= 20 AND length(s) >= 20"""
)
def build_mcq(spark: SparkSession, folder: str) -> DataFrame:
    """Single-choice questions as examples."""
    made = builders.choice_examples(table(spark, folder, "mcq").withColumnRenamed("id", "orig_id"), ["orig_id"])
    return made.select("orig_id", big(F.col("meta.answer_idx")).alias("answer_idx"), F.element_at("messages", -1).content.alias("answer"), "id")


_LEFT_OUT = (("GARDE", "Libra"), ("inheritance", "stages"))


@register(
    f"""WITH x AS (SELECT document_id, {O.clean('document_source')} AS src, lower({O.clean('question_type')}) AS kind, {O.clean('question')} AS u, {O.clean('answer')} AS a0 FROM reference_qa),
    y AS (SELECT *, {O.cut('a0', 300)} AS s FROM x WHERE src NOT IN ('GARDE', 'Libra') AND kind NOT IN ('inheritance', 'stages'))
    SELECT document_id, src AS document_source, kind AS question_type, {O.pair_id('reference', 'reference_qa', P.REFERENCE_SYSTEM, 'u', 's')} AS id FROM y WHERE length(u) >= 20 AND length(s) >= 20"""
)
def build_reference_qa(spark: SparkSession, folder: str) -> DataFrame:
    """Reference questions as examples; sources are left out as spelled, kinds of question whatever their case."""
    from sparkloom.plans.config import Lengths

    made = builders.reference_examples(table(spark, folder, "reference_qa"), ["document_id"], Lengths(reference_answer=300), excluded_sources=_LEFT_OUT[0], excluded_types=_LEFT_OUT[1])
    return made.select("document_id", "meta.document_source", "meta.question_type", "id")


def _notes_sql(dialogue: bool) -> str:
    bare = "(ti = '' OR contains(ni, ti))" if dialogue else "(ti <> '' AND contains(ni, ti))"
    system, task = (P.CONSULT_SYSTEM, "single_turn_reference") if dialogue else (P.REFERENCE_SYSTEM, "reference_qa")
    opening = f"AND NOT regexp_matches(lower(u), '\\A(?:{O.alternatives(P.PROVIDER_OPENINGS)})')" if dialogue else ""
    return f"""WITH x AS (SELECT document_id, {O.clean('question_type')} AS t, {O.clean('question')} AS i, {O.footer('answer', 3500)} AS s FROM reference_qa),
    y AS (SELECT *, {O.norm('t')} AS ti, {O.norm('i')} AS ni FROM x WHERE s <> ''),
    z AS (SELECT *, CASE WHEN t <> '' AND i <> '' THEN CASE WHEN {bare} THEN i ELSE 'Topic: ' || t || chr(10) || chr(10) || i END WHEN i <> '' THEN i ELSE t END AS u FROM y)
    SELECT document_id, u AS prompt, {O.pair_id('notes', task, system, 'u', 's')} AS id FROM z WHERE length(u) >= 20 AND length(s) >= 20 {opening}"""


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_qa").select("document_id", F.col("question_type").alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output"))


@register(_notes_sql(False))
def build_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Topic, input and output as examples."""
    return builders.notes_examples(_notes(spark, folder), ["document_id"]).select("document_id", F.get("messages", 1).content.alias("prompt"), "id")


@register(_notes_sql(True))
def build_notes_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """The same for dialogue mixtures."""
    return builders.notes_examples(_notes(spark, folder), ["document_id"], dialogue=True).select("document_id", F.get("messages", 1).content.alias("prompt"), "id")


def _task_sql(source: str, task: str, system: str, most_in: int, most_out: int, fine: str) -> str:
    return f"""WITH x AS (SELECT id AS orig_id, {O.clean(f"question || ' ' || {_pick('question', _WORDS)}")} AS n, {O.clean('topic_name')} AS i0, {O.clean('exp')} AS s0 FROM mcq),
    y AS (SELECT *, {O.cut('i0', most_in)} AS i, {O.cut('s0', most_out)} AS s FROM x),
    z AS (SELECT *, CASE WHEN n <> '' AND i <> '' THEN 'Instruction: ' || n || chr(10) || chr(10) || 'Input: ' || i WHEN n <> '' THEN n ELSE i END AS u FROM y WHERE {fine})
    SELECT orig_id, {O.pair_id(source, task, system, 'u', 's')} AS id FROM z WHERE length(u) >= 20 AND length(s) >= 20"""


_DROPPED = f"NOT regexp_matches(lower(n || chr(10) || s), '{O.alternatives(P.EXTRACTION_TASKS)}')"
_PLAIN = "lower(n || chr(10) || i || chr(10) || s)"
_KEPT = f"NOT (contains({_PLAIN}, '```') OR regexp_matches({_PLAIN}, '{O.alternatives(P.CODE_WORDS)}') OR regexp_matches({_PLAIN}, '{O.alternatives(P.UNSAFE_WORDS)}'))"


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mcq").select(F.col("id").alias("orig_id"), F.concat("question", F.lit(" "), _picked("question", _WORDS)).alias("instruction"), F.col("topic_name").alias("more"), "exp")


@register(_task_sql("task", "instruction", P.REFERENCE_SYSTEM, 8000, 3500, _DROPPED))
def build_instruction(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions as examples."""
    return builders.task_examples(_tasks(spark, folder).selectExpr("orig_id", "instruction", "more as input", "exp as output"), ["orig_id"]).select("orig_id", "id")


@register(_task_sql("general", "general_instruction", P.GENERAL_SYSTEM, 6000, 2200, _KEPT))
def build_general(spark: SparkSession, folder: str) -> DataFrame:
    """General instructions as examples."""
    rows = _tasks(spark, folder).selectExpr("orig_id", "instruction", "more as context", "exp as response", "cast(null as string) as category")
    return builders.general_examples(rows, ["orig_id"]).select("orig_id", "id")


@register("SELECT split, count(*) AS n FROM mcq WHERE split = 'validation' GROUP BY split")
def optional_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The validation split under whichever of its names comes first."""
    return optional_split(table(spark, folder, "mcq"), "validation", "valid").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- Deduplication and sampling -------------------------------------------------------

_PRIORITY = ("intake_qa", "exam_dialog", "clinic_chat", "meadow_notes", "exam_mcq", "ref_pages", "bio_tasks", "open_tasks")
_LENIENT = _PRIORITY[:2]


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.pool_of_records(spread(table(spark, folder, "finetune_data")))


@register(f"WITH {O.POOL}, d AS (SELECT *, row_number() OVER (PARTITION BY source, split, user_sig ORDER BY pos) AS rn FROM pool) SELECT pos, source, split FROM d WHERE rn = 1")
def dedup_pool(spark: SparkSession, folder: str) -> DataFrame:
    """First of equal questions within each source and split."""
    return dedup.dedup_pool(_pool(spark, folder), within=("source", "split")).select("pos", "source", "split")


@register(f"WITH {O.POOL}, d AS (SELECT *, row_number() OVER (PARTITION BY split, user_sig ORDER BY {O.priority('source', _PRIORITY)}, pos) AS rn FROM pool) SELECT pos, source, split FROM d WHERE rn = 1")
def dedup_priority(spark: SparkSession, folder: str) -> DataFrame:
    """First of equal questions across sources by priority."""
    return dedup.dedup_by_priority(_pool(spark, folder), _PRIORITY).select("pos", "source", "split")


_TWO_RULES = f"""d AS (SELECT *, row_number() OVER (PARTITION BY split, user_sig ORDER BY {O.priority('source', _PRIORITY)}, pos) AS ru,
    row_number() OVER (PARTITION BY split, full_sig ORDER BY {O.priority('source', _PRIORITY)}, pos) AS rf FROM pool),
    kept AS (SELECT * FROM d WHERE CASE WHEN source IN ('intake_qa', 'exam_dialog') THEN rf = 1 ELSE ru = 1 END)"""


@register(f"WITH {O.POOL}, {_TWO_RULES} SELECT pos, source, split FROM kept")
def dedup_lenient_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Some sources may share a first question."""
    return dedup.dedup_lenient_strict(_pool(spark, folder), _PRIORITY, _LENIENT).select("pos", "source", "split")


@register("SELECT DISTINCT document_source, question_type FROM reference_qa")
def drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Each combination once."""
    return dedup.drop_exact_duplicates(table(spark, folder, "reference_qa"), ["document_source", "question_type"])


_SPLITS = (SplitSize("clinic_chat", 120, 150, 42), SplitSize("exam_dialog", 40, 60, 43), SplitSize("meadow_notes", 30, 20, 44), SplitSize("open_tasks", 10, 400_000, 45))


@register(
    f"""WITH {O.POOL}, s(source, val, test, seed) AS (VALUES {', '.join(f"('{x.source}', {x.val}, {x.test}, {x.seed})" for x in _SPLITS)}),
    r2 AS (SELECT pos, pool.source, val, test, row_number() OVER (PARTITION BY pool.source ORDER BY md5(seed::VARCHAR || '|' || coalesce(id, '')), pos) AS k FROM pool JOIN s ON pool.source = s.source)
    SELECT pos, source, CASE WHEN k <= test THEN 'test' WHEN k <= test + val THEN 'val' ELSE 'train' END AS split FROM r2"""
)
def split_random(spark: SparkSession, folder: str) -> DataFrame:
    """Train, val and test of fixed sizes, test first."""
    # Ranks read their rows twice: the texts are cleaned once.
    return sampling.split_random(durable(_pool(spark, folder).select("pos", "id", "source"), "pool"), _SPLITS).select("pos", "source", "split")


_TARGETS = (
    MixtureTarget("stage1", "clinic_chat", 700, 52), MixtureTarget("stage1", "exam_dialog", 1000, 53), MixtureTarget("stage1", "meadow_notes", 130, 54), MixtureTarget("stage1", "bio_tasks", 0, 55),
    MixtureTarget("stage2", "clinic_chat", 100, 62), MixtureTarget("stage2", "intake_qa", 900, 63), MixtureTarget("stage2", "open_tasks", 60, 64),
)
_DRAW = f"""tg(stage, source, target, seed) AS (VALUES {', '.join(f"('{x.stage}', '{x.source}', {x.target}, {x.seed})" for x in _TARGETS if x.target > 0)}),
    sz AS (SELECT source, count(*) AS have FROM base GROUP BY source),
    pa AS (SELECT stage, tg.source, target, seed, unnest(range(0, CAST(ceil(target / have) AS BIGINT))) AS k FROM tg JOIN sz ON tg.source = sz.source),
    rk AS (SELECT stage, pa.source, target, k, pos, id, turns, row_number() OVER (PARTITION BY stage, pa.source ORDER BY k, md5(seed::VARCHAR || '|' || k::VARCHAR || '|' || coalesce(id, '')), pos) AS rn FROM base JOIN pa ON base.source = pa.source),
    drawn AS (SELECT stage, source, pos, k AS repeat_idx, turns, CASE WHEN k = 0 THEN id ELSE substring(sha256(coalesce(id, '') || {O.SEP} || k::VARCHAR), 1, 24) END AS id FROM rk WHERE rn <= target)"""


@register(f"WITH {O.POOL}, base AS (SELECT * FROM pool WHERE split = 'train'), {_DRAW} SELECT stage, source, pos, CAST(repeat_idx AS BIGINT) AS repeat_idx, id FROM drawn")
def mixture_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Draws without repetition, and with it, to fixed targets."""
    drawn = sampling.draw_to_targets(durable(_pool(spark, folder).where("split = 'train'").select("pos", "id", "source"), "pool"), _TARGETS)
    return drawn.select("stage", "source", "pos", big(F.col("repeat_idx")).alias("repeat_idx"), "id")


_PLAN = MixturePlan(priority=_PRIORITY, lenient=_LENIENT, splits=_SPLITS[:3], targets=_TARGETS)
_SPLIT_BASE = f"""s(source, val, test, seed) AS (VALUES {', '.join(f"('{x.source}', {x.val}, {x.test}, {x.seed})" for x in _SPLITS[:3])}),
    pool0 AS (SELECT pos, id, source, turns, user_sig, full_sig, split FROM rawpool WHERE source NOT IN (SELECT source FROM s)
      UNION ALL SELECT pos, id, source, turns, user_sig, full_sig, CASE WHEN k <= test THEN 'test' WHEN k <= test + val THEN 'val' ELSE 'train' END AS split
      FROM (SELECT rawpool.*, val, test, row_number() OVER (PARTITION BY rawpool.source ORDER BY md5(seed::VARCHAR || '|' || coalesce(id, '')), pos) AS k FROM rawpool JOIN s ON rawpool.source = s.source)),
    pool AS (SELECT * FROM pool0)"""


@register(
    f"""WITH {O.POOL.replace('pool AS (', 'rawpool AS (')}, {_SPLIT_BASE}, {_TWO_RULES}, base AS (SELECT * FROM kept WHERE split = 'train'), {_DRAW},
    a AS (SELECT 'pool' AS part, split, source, turns FROM pool UNION ALL SELECT 'unique', split, source, turns FROM kept UNION ALL SELECT stage, 'train', source, turns FROM drawn)
    SELECT part, split, source, count(*) AS n, CAST(sum(turns) AS BIGINT) AS turns, round(avg(turns), 3) AS avg_turns, max(turns) AS max_turns FROM a GROUP BY part, split, source"""
)
def dialogue_mixture_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A whole dialogue mixture: pools, splits, deduplication, draws; its statistics."""
    return mixture.dialogue_mixture(_pool(spark, folder), _PLAN).stats()


_KNOWLEDGE = MixturePlan(priority=("exam_mcq", "ref_pages", "bio_tasks", "meadow_notes", "open_tasks"), splits=(SplitSize("ref_pages", 20, 20, 52), SplitSize("bio_tasks", 30, 40, 54)))


@register(
    f"""WITH {O.POOL.replace('pool AS (', 'p0 AS (')}, s(source, val, test, seed) AS (VALUES ('ref_pages', 20, 20, 52), ('bio_tasks', 30, 40, 54)),
    p1 AS (SELECT * FROM p0 WHERE source IN ('exam_mcq', 'ref_pages', 'bio_tasks', 'meadow_notes', 'open_tasks')),
    q1 AS (SELECT *, row_number() OVER (PARTITION BY source, split, user_sig ORDER BY pos) AS r1, row_number() OVER (PARTITION BY source, user_sig ORDER BY pos) AS r2 FROM p1),
    q2 AS (SELECT pos, source, user_sig, split FROM q1 WHERE r1 = 1 AND source NOT IN (SELECT source FROM s)
      UNION ALL SELECT pos, source, user_sig, CASE WHEN k <= test THEN 'test' WHEN k <= test + val THEN 'val' ELSE 'train' END
      FROM (SELECT q1.*, val, test, row_number() OVER (PARTITION BY q1.source ORDER BY md5(seed::VARCHAR || '|' || coalesce(id, '')), pos) AS k FROM q1 JOIN s ON q1.source = s.source WHERE r2 = 1)),
    q3 AS (SELECT *, row_number() OVER (PARTITION BY split, user_sig ORDER BY {O.priority('source', _KNOWLEDGE.priority)}, pos) AS r3 FROM q2)
    SELECT 'before' AS part, split, source, count(*) AS n FROM q2 GROUP BY split, source UNION ALL SELECT 'after', split, source, count(*) FROM q3 WHERE r3 = 1 GROUP BY split, source"""
)
def knowledge_pool_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """A knowledge mixture's pools before and after deduplication across sources."""
    pools = _pool(spark, folder).where(F.col("source").isin(*_KNOWLEDGE.priority))
    return mixture.pool_sizes(mixture.knowledge_mixture(pools, _KNOWLEDGE))


@register(
    f"""WITH r AS (SELECT record_id, {O.name('source')} AS source FROM finetune_data),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || record_id::VARCHAR), record_id) AS rn, count(*) OVER (PARTITION BY source) AS c FROM r),
    h AS (SELECT *, floor(c * 0.2 + 0.5) AS held FROM k)
    SELECT record_id, source, CASE WHEN rn <= floor(held / 2) THEN 'val' WHEN rn <= held THEN 'test' ELSE 'train' END AS split FROM h"""
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Train, val and test with each source's share."""
    rows = table(spark, folder, "finetune_data").select("record_id", X.normal_name(F.col("source")).alias("source"))
    return sampling.stratified_split(rows, "record_id", "source")


@register("SELECT record_id, split FROM finetune_data ORDER BY record_id LIMIT 20")
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows by position: the limit is the operator."""
    return sampling.head(table(spark, folder, "finetune_data").select("record_id", "split"), 20, "record_id")


@register("SELECT record_id, row_number() OVER (ORDER BY md5('7|' || record_id::VARCHAR)) - 1 AS place FROM finetune_data")
def global_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their place in seeded order, found as a writer of ordered files would."""
    rows = table(spark, folder, "finetune_data").select("record_id", sampling.seeded(7, "record_id").alias("_key"))
    return chat.dense_position(rows, "_key", "place").select("record_id", "place")


@register("SELECT split, record_id, row_number() OVER (PARTITION BY split ORDER BY md5('9|' || record_id::VARCHAR)) AS place FROM finetune_data")
def split_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each row in the seeded order of its split."""
    rows = table(spark, folder, "finetune_data").select("split", "record_id")
    return sampling.ranked(rows, ["split"], sampling.seeded(9, "record_id"), ["record_id"], "place").select("split", "record_id", "place")


# --- Summaries ------------------------------------------------------------------------


@register(
    f"""WITH r AS (SELECT {O.name('source')} AS source, {O.name('task')} AS task FROM finetune_data)
    SELECT 'all' AS by, NULL AS name, count(*) AS n FROM r UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source UNION ALL SELECT 'task', task, count(*) FROM r GROUP BY task"""
)
def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in all, by source and by task."""
    return stats.summary(table(spark, folder, "finetune_data").select(X.normal_name(F.col("source")).alias("source"), X.normal_name(F.col("task")).alias("task")))


@register("SELECT split, coalesce(source, 'unknown') AS source, count(*) AS n FROM finetune_data GROUP BY split, coalesce(source, 'unknown')")
def summary_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by split and source as spelled."""
    return stats.count_by(table(spark, folder, "finetune_data"), "split", "source", missing="unknown")


@register(
    f"""WITH r AS (SELECT {O.name('source')} AS source, coalesce(len(list_filter(messages, lambda m: m.role <> 'system')), 0) AS t FROM finetune_data)
    SELECT source, count(*) AS n, CAST(sum(t) AS BIGINT) AS turns, round(avg(t), 3) AS avg_turns, max(t) AS max_turns FROM r GROUP BY source"""
)
def dialogue_turn_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Turns per source."""
    return stats.turn_stats(table(spark, folder, "finetune_data").select(X.normal_name(F.col("source")).alias("source"), "messages"), "source")


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"))


@register("SELECT count(*) AS n, round(avg(l), 6) AS mean, max(l) AS max, " + ", ".join(f"round(quantile_cont(l, {p / 100}), 6) AS p{p}" for p in P.LENGTH_PERCENTILES) + " FROM (SELECT coalesce(length(text), 0) AS l FROM documents)")
def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of lengths."""
    got = stats.length_profile(_lengths(spark, folder))
    return got.select("n", F.round("mean", 6).alias("mean"), "max", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in P.LENGTH_PERCENTILES])


@register("SELECT count(*) AS n, count(*) FILTER (WHERE l > 2048) AS n_over, round(count(*) FILTER (WHERE l > 2048) / count(*), 6) AS share_over FROM (SELECT coalesce(length(text), 0) AS l FROM documents)")
def truncation_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Texts beyond a limit."""
    return stats.length_profile(_lengths(spark, folder)).select("n", "n_over", F.round("share_over", 6).alias("share_over"))


_EDGES = [*P.LENGTH_EDGES, None]


@register(
    " UNION ALL ".join(
        f"SELECT CAST({lo} AS BIGINT) AS low, CAST({'NULL' if hi is None else hi} AS BIGINT) AS high, count(*) FILTER (WHERE l > {lo}{'' if hi is None else f' AND l <= {hi}'}) AS n FROM (SELECT coalesce(length(text), 0) AS l FROM documents)"
        for lo, hi in zip(_EDGES, _EDGES[1:])
    )
)
def length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of lengths."""
    return stats.length_histogram(_lengths(spark, folder))


@register(
    f"""SELECT split, count(*) AS total, count(*) FILTER (WHERE coalesce(len(messages) >= 2
      AND len(list_filter(messages, lambda m: NOT coalesce(m.role IN ('system', 'user', 'assistant') AND {O.strip('m.content')} <> '', false))) = 0
      AND len(list_filter(messages, lambda m: m.role = 'assistant')) > 0, false)) AS kept FROM finetune_data GROUP BY split"""
)
def kept_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows before and after validation."""
    return stats.kept_counts(table(spark, folder, "finetune_data"), M.is_trainable(F.col("messages")), "split")


# --- Benchmark ------------------------------------------------------------------------

_LAST = "last AS (SELECT prompt_id, arg_max(coalesce(response, 'None'), line_no) AS response, max(line_no) AS line_no, count(*) AS n FROM generation WHERE prompt_id IS NOT NULL GROUP BY prompt_id)"


@register(f"WITH {_LAST} SELECT b.prompt_id, response, CAST(len(rubrics) AS BIGINT) AS rubrics, array_to_string(example_tags, '|') AS tags FROM benchmark_prompt b JOIN last ON b.prompt_id = last.prompt_id")
def judge_join(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark rows with their response."""
    rows = judge.judge_rows(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation"))
    return rows.select("prompt_id", F.get("prompt_response", 0).content.alias("response"), big(F.size("rubrics")).alias("rubrics"), F.array_join("example_tags", "|").alias("tags"))


@register("SELECT prompt_id FROM benchmark_prompt b WHERE NOT EXISTS (SELECT 1 FROM generation g WHERE g.prompt_id = b.prompt_id)")
def judge_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark rows without a response."""
    return judge.unanswered(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation")).select("prompt_id")


@register("SELECT DISTINCT prompt_id FROM generation WHERE prompt_id IS NOT NULL AND prompt_id NOT IN (SELECT prompt_id FROM benchmark_prompt WHERE prompt_id IS NOT NULL) ORDER BY prompt_id LIMIT 10")
def judge_unmatched_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten ids of responses without a benchmark row: the limit is the operator."""
    return judge.unmatched_ids(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation")).orderBy("prompt_id").limit(10)


@register("SELECT prompt_id, count(*) AS n FROM generation WHERE prompt_id IS NOT NULL GROUP BY prompt_id HAVING count(*) > 1")
def judge_dup_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with several responses."""
    return judge.duplicate_ids(table(spark, folder, "generation"))


@register(f"WITH {_LAST} SELECT prompt_id, response, line_no, n FROM last")
def keep_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last response of each id."""
    return judge.last_responses(table(spark, folder, "generation"))


@register(
    f"""WITH {_LAST} SELECT (SELECT count(*) FROM benchmark_prompt b JOIN last ON b.prompt_id = last.prompt_id) AS written,
    (SELECT count(*) FROM benchmark_prompt b WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.prompt_id = b.prompt_id)) AS skipped,
    (SELECT count(*) FROM last WHERE NOT EXISTS (SELECT 1 FROM benchmark_prompt b WHERE last.prompt_id = b.prompt_id)) AS unmatched,
    (SELECT count(*) FROM last WHERE n > 1) AS duplicated"""
)
def judge_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """What the join wrote and left over."""
    return judge.reconciliation(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation"))


# --- Classification -------------------------------------------------------------------

_LABELS = ("symptoms", "treatment", "causes", "prevention")
_CLEANED = f"""c0 AS (SELECT lower({O.strip("coalesce(question_type, '')")}) AS label, {O.squeeze("coalesce(question_focus, '')")} AS sentence FROM reference_qa),
    c1 AS (SELECT DISTINCT label, sentence FROM c0 WHERE sentence <> '' AND label IN ('symptoms', 'treatment', 'causes', 'prevention')),
    c2 AS (SELECT * FROM c1 WHERE sentence NOT IN (SELECT sentence FROM c1 GROUP BY sentence HAVING count(DISTINCT label) > 1))"""


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    return classify.clean_sentences(table(spark, folder, "reference_qa"), _LABELS, "question_type", "question_focus")


@register(f"WITH {_CLEANED} SELECT label, sentence, CAST(list_position(['symptoms', 'treatment', 'causes', 'prevention'], label) - 1 AS BIGINT) AS label_id FROM c2")
def conflict_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled sentences without conflicts, their labels as numbers."""
    return _sentences(spark, folder).withColumn("label_id", big(classify.encode_label(F.col("label"), _LABELS)))


@register(f"WITH {_CLEANED} SELECT label, count(*) AS n FROM c2 GROUP BY label")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences by label."""
    return stats.count_by(_sentences(spark, folder), "label").orderBy(F.desc("n"), "label")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    # No class 5 is ever predicted, and one that no row has is.
    return table(spark, folder, "reading_labels").select(F.col("band").alias("gold"), F.when(F.col("doc_id") % 5 == 4, 6).otherwise(F.col("doc_id") % 5 + 1).cast("int").alias("pred"))


_PRED = "p AS (SELECT band AS gold, CAST(CASE WHEN doc_id % 5 = 4 THEN 6 ELSE doc_id % 5 + 1 END AS INTEGER) AS pred FROM reading_labels WHERE band IS NOT NULL)"
_SCORES = f"""{_PRED}, l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p),
    s AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM p WHERE gold = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS predicted FROM l),
    sc AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f, support FROM s)"""
_R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


@register(f"WITH {_PRED} SELECT count(*) AS n, count(*) FILTER (WHERE gold = pred) AS correct, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Share of right predictions."""
    return classify.accuracy(_predictions(spark, folder)).select("n", "correct", *_R6("accuracy"))


@register(f"WITH {_SCORES} SELECT CAST(label AS BIGINT) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM sc")
def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 per class."""
    return classify.class_scores(_predictions(spark, folder)).select(big(F.col("label")).alias("label"), *_R6("precision", "recall", "f1"), "support")


_AVERAGES = """SELECT 'macro' AS average, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM sc
    UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM sc"""


@register(f"WITH {_SCORES} {_AVERAGES}")
def prf_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Macro and weighted averages."""
    return classify.averages(_predictions(spark, folder)).select("average", *_R6("precision", "recall", "f1"), "support")


@register(f"WITH {_PRED}, l(gold) AS (VALUES (1), (2), (3), (4), (5), (6)) SELECT CAST(l.gold AS BIGINT) AS gold, " + ", ".join(f"count(*) FILTER (WHERE pred = {k}) AS pred_{k}" for k in range(1, 7)) + " FROM l LEFT JOIN p ON l.gold = p.gold GROUP BY l.gold")
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion matrix over the full list of classes."""
    return classify.confusion(_predictions(spark, folder), range(1, 7))


@register(
    f"""WITH {_SCORES}, a AS ({_AVERAGES}) SELECT label::VARCHAR AS name, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM sc UNION ALL SELECT average, precision, recall, f1, support FROM a
    UNION ALL SELECT 'accuracy', round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6), round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6), count(*) FROM p"""
)
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    """All class measures in one table."""
    return classify.report(_predictions(spark, folder)).select("name", *_R6("precision", "recall", "f1"), "support")


@register("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def argmax(spark: SparkSession, folder: str) -> DataFrame:
    """The place of the greatest score."""
    return table(spark, folder, "embeddings").select("vec_id", big(classify.argmax(F.col("embedding"))).alias("best"))


# --- Dialogue state, batches, schedules -----------------------------------------------


@register(
    f"""WITH {O.TURNS}, n AS (SELECT id, rid, g, row_number() OVER (PARTITION BY rid ORDER BY g) AS turn, role, content FROM t)
    SELECT id, turn, CAST(turn AS BIGINT) AS history_turns, md5(array_to_string(list(role || ': ' || content) OVER (PARTITION BY rid ORDER BY g), chr(10))) AS history FROM n"""
)
def chat_history_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The history each turn of a dialogue sees."""
    rows = _turns(spark, folder).where("size(turns) > 0").select("id", F.posexplode(chat.prefixes_of(F.col("turns"))).alias("turn", "history"))
    said = F.array_join(F.transform("history", lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n")
    return rows.select("id", big(F.col("turn") + 1).alias("turn"), big(F.size("history")).alias("history_turns"), F.md5(said).alias("history"))


@register("SELECT line_no, CAST(floor((row_number() OVER (ORDER BY line_no) - 1) / 16) AS BIGINT) AS batch, prompt_id, response FROM generation")
def prompt_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of sixteen in order."""
    rows = chat.dense_position(table(spark, folder, "generation").select("line_no", "prompt_id", "response"), "line_no")
    return chat.batch_numbers(rows, 16).select("line_no", big(F.col("batch")).alias("batch"), "prompt_id", "response")


_TOKENS = "regexp_extract_all(coalesce({0}, ''), '[\\pL\\pN_]+|[^\\pL\\pN_\\s\\pZ]')"


def _lengths_of(texts: list[str]) -> list[list[int]]:
    """A stand-in for ids: the length of each token."""
    return [list(map(len, tokens)) for tokens in hooks.word_tokenizer(texts)]


@register(f"SELECT id, array_to_string(list_transform({_TOKENS.format('exp')}[1:12], lambda x: length(x)), ' ') AS ids FROM mcq")
def encode_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """Texts encoded and cut by a pluggable tokenizer, a batch at a time."""
    return table(spark, folder, "mcq").select("id", F.array_join(hooks.encode_truncated(F.col("exp"), _lengths_of, 12).cast("array<string>"), " ").alias("ids"))


@register(
    f"""WITH t AS (SELECT (line_no - 1) // 8 AS batch, len({_TOKENS.format('response')}[1:40]) AS n, list_sum(list_transform({_TOKENS.format('response')}[1:40], lambda x: length(x))) AS s FROM generation)
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, CAST(max(n) AS BIGINT) AS width, CAST(sum(n) AS BIGINT) AS unmasked, CAST(coalesce(sum(s), 0) AS BIGINT) AS total FROM t GROUP BY batch"""
)
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches padded to their longest row: size, width, cells that aren't padding, sum of the ids."""
    rows = table(spark, folder, "generation").select(F.floor((F.col("line_no") - 1) / 8).alias("batch"), "line_no", hooks.encode_truncated(F.col("response"), _lengths_of, 40).alias("ids"))
    made = hooks.padded_batches(rows, "batch", "line_no")
    total = lambda c: big(F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a + x))
    return made.select("batch", big(F.size("input_ids")).alias("rows"), big(F.size(F.get("input_ids", 0))).alias("width"), total("attention_mask").alias("unmasked"), total("input_ids").alias("total"))


@register("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events in windows of event time."""
    return windowed_counts(table(spark, folder, "events")).withColumn("total", F.round("total", 4))


@register("SELECT event_type AS tag, event_id AS step, value FROM events WHERE event_type = 'purchase'")
def scalar_series(spark: SparkSession, folder: str) -> DataFrame:
    """The series of one tag of a log."""
    from sparkloom.sources.readers import scalar_series as series

    log = table(spark, folder, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return series(log, "purchase").select(F.lit("purchase").alias("tag"), "step", "value")


@register("SELECT DISTINCT event_type AS tag FROM events")
def scalar_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tags of a log."""
    return table(spark, folder, "events").select(F.col("event_type").alias("tag")).distinct()


@register("SELECT 'layer' AS part, i AS layer, round(2e-5 * pow(0.9, 11 - i) * 1e9, 6) AS rate_e9 FROM range(12) t(i) UNION ALL SELECT 'head', NULL, 20000.0 UNION ALL SELECT 'embeddings', NULL, round(2e-5 * pow(0.9, 12) * 1e9, 6)")
def llrd_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Learning rates by layer."""
    return schedules.layer_rates(spark, 12).select("part", "layer", F.round(F.col("rate") * 1e9, 6).alias("rate_e9"))


@register("SELECT split, CAST(greatest(floor(count(*) / 16), 1) * 3 AS BIGINT) AS steps, CAST(floor(greatest(floor(count(*) / 16), 1) * 3 * 0.1) AS BIGINT) AS warmup FROM finetune_data GROUP BY split")
def step_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Training steps by split."""
    steps, warmup = schedules.step_budget(F.col("n"), 16, 3, 0.1)
    return stats.count_by(table(spark, folder, "finetune_data"), "split").select("split", big(steps).alias("steps"), big(warmup).alias("warmup"))


@register(f"SELECT id, len({_TOKENS.format('question')}) AS tokens, len({_TOKENS.format('question')}) AS built_in FROM mcq")
def token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens by a pluggable tokenizer."""
    return table(spark, folder, "mcq").select("id", hooks.token_lengths(F.col("question"), hooks.word_tokenizer).alias("tokens"), hooks.word_counts(F.col("question")).alias("built_in"))


@register(
    """SELECT prompt_id, length(text)::VARCHAR || ' <|assistant|>' AS response FROM (SELECT prompt_id, (SELECT coalesce(string_agg('<|' || m.role || '|>' || chr(10) || coalesce(m.content, '') || chr(10), '' ORDER BY i), '')
    FROM (SELECT unnest(prompt) AS m, unnest(range(len(prompt))) AS i)) || '<|assistant|>' || chr(10) AS text FROM benchmark_prompt WHERE prompt IS NOT NULL AND len(list_filter(prompt, lambda m: m.role IS NULL)) = 0)"""
)
def batch_inference(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of a pluggable batch model."""
    rows = table(spark, folder, "benchmark_prompt").where("prompt is not null and not exists(prompt, m -> m.role is null)")
    rows = rows.select("prompt_id", M.render_chat(F.col("prompt"), generation_prompt="<|assistant|>\n").alias("prompt"))
    return hooks.generate(rows, "prompt", hooks.echo_model).select("prompt_id", "response")


@register()
def nfkc_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned documents with compatibility characters brought together."""
    return table(spark, folder, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


# --- Set operations and small closed forms --------------------------------------------


@register("SELECT 'dialogue' AS pool, id AS key FROM dialogue UNION ALL SELECT 'mcq', id FROM mcq UNION ALL SELECT 'reference', document_id FROM reference_qa")
def union_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Pools one after the other."""
    parts = [table(spark, folder, t).select(F.lit(n).alias("pool"), F.col(k).alias("key")) for t, n, k in (("dialogue", "dialogue", "id"), ("mcq", "mcq", "id"), ("reference_qa", "reference", "document_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT prompt_id FROM generation WHERE prompt_id IS NOT NULL EXCEPT SELECT prompt_id FROM benchmark_prompt")
def except_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of responses without a benchmark row."""
    return judge.unmatched_ids(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation"))


@register("SELECT prompt_id, line_no, substring(coalesce(response, ''), 1, 60) AS preview FROM generation")
def preview_text(spark: SparkSession, folder: str) -> DataFrame:
    """Beginnings of texts."""
    return table(spark, folder, "generation").select("prompt_id", "line_no", X.preview(F.col("response"), 60).alias("preview"))


@register(f"SELECT id, ['A', 'B', 'C', 'D'][CAST({_INDEX} AS BIGINT) + 1] AS label, [opa, opb, opc, opd][CAST({_INDEX} AS BIGINT) + 1] AS option FROM mcq")
def option_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Correct options by label and text."""
    at = X.choice_index(F.col("cop"))
    return table(spark, folder, "mcq").select("id", X.option_label(at).alias("label"), F.get(F.array("opa", "opb", "opc", "opd"), at).alias("option"))


@register("SELECT i AS step, round(1e6 * 2e-5 * CASE WHEN i < 10 THEN i / 10.0 ELSE greatest(0.0, (100 - i) / 90.0) END, 6) AS rate_e6 FROM range(0, 121) t(i)")
def linear_warmup(spark: SparkSession, folder: str) -> DataFrame:
    """Learning rates by step."""
    return spark.range(0, 121).select(F.col("id").alias("step"), F.round(1e6 * schedules.linear_rate(F.col("id"), 100, 10, 2e-5), 6).alias("rate_e6"))


_PARAMETERS = ("embeddings.word.weight", "layer.0.attention.bias", "layer.0.LayerNorm.weight", "layer.1.LayerNorm.bias", "layer.1.dense.weight", "head.bias")


@register(f"SELECT name, CASE WHEN contains(name, 'bias') OR contains(name, 'LayerNorm.weight') THEN 'no_decay' ELSE 'decay' END AS grp FROM (VALUES {', '.join(f'({O.quote(p)})' for p in _PARAMETERS)}) t(name)")
def decay_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters by whether weight decay applies."""
    return spark.createDataFrame([(p,) for p in _PARAMETERS], "name string").select("name", schedules.decay_group(F.col("name")).alias("grp"))


@register("SELECT split, round(100.0 * count(*) FILTER (WHERE source IS NULL) / count(*), 6) AS percent FROM finetune_data GROUP BY split")
def ratio_percent(spark: SparkSession, folder: str) -> DataFrame:
    """A part in percent of the whole."""
    rows = table(spark, folder, "finetune_data").groupBy("split").agg(F.count(F.when(F.col("source").isNull(), 1)).alias("a"), F.count(F.lit(1)).alias("b"))
    return rows.select("split", F.round(schedules.trainable_percent(F.col("a"), F.col("b")), 6).alias("percent"))


@register("SELECT band, CAST(CASE band WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 END AS BIGINT) AS label_id, CASE band WHEN 1 THEN 'negative' WHEN 3 THEN 'neutral' WHEN 5 THEN 'positive' END AS label, doc_id FROM reading_labels")
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Labels to numbers and back."""
    named = F.when(F.col("band") == 1, "negative").when(F.col("band") == 3, "neutral").when(F.col("band") == 5, "positive")
    code = classify.encode_label(named)
    return table(spark, folder, "reading_labels").select(big(F.col("band")).alias("band"), big(code).alias("label_id"), classify.decode_label(code).alias("label"), "doc_id")


@register("SELECT doc_id, rater, CASE band WHEN 1 THEN 'easy' WHEN 5 THEN 'hard' END AS name FROM reading_labels")
def label_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of values in a small mapping."""
    return table(spark, folder, "reading_labels").select("doc_id", "rater", classify.map_values(F.col("band").cast("string"), {"1": "easy", "5": "hard"}).alias("name"))


# --- Sources and sinks: written to the shared folder, read back -----------------------


@register("SELECT record_id, id, source, messages[1].content AS first, len(messages) AS n FROM finetune_data")
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Examples as JSON lines and back."""
    path = new_folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, folder, "finetune_data").select("source", "task", "messages", "id", "record_id"), path)
    rows = readers.read_jsonl(spark, path, f"record_id long, id string, source string, messages {M.MESSAGES}")
    return rows.select("record_id", "id", "source", F.get("messages", 0).content.alias("first"), big(F.when(F.col("messages").isNotNull(), F.size("messages"))).alias("n"))


@register("SELECT record_id, id, CASE split WHEN 'train' THEN 'train' ELSE 'eval' END AS split FROM finetune_data WHERE split IN ('train', 'test')")
def split_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of several splits as one table."""
    own = table(spark, folder, "finetune_data").select("record_id", "id", "split")
    files = {name: new_folder(spark, name) for name in ("train", "eval")}
    for name, split in (("train", "train"), ("eval", "test")):
        sinks.write_jsonl(own.where(F.col("split") == split).drop("split"), files[name])
    return readers.read_splits(spark, files, "record_id long, id string").select("record_id", "id", "split")


@register("SELECT prompt_id, coalesce(response, 'None') AS response, count(*) AS n FROM generation WHERE prompt_id IS NOT NULL GROUP BY 1, 2")
def generations_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Responses as JSON lines and back, each line checked."""
    path = new_folder(spark, "generations")
    rows = table(spark, folder, "generation").where("prompt_id is not null")
    sinks.write_generations(rows.withColumn("response", F.coalesce("response", F.lit("None"))), path)
    return stats.count_by(readers.read_generations(spark, path), "prompt_id", "response")


@register("SELECT trim(subject_name) AS label, trim(topic_name) AS sentence, count(*) AS n FROM mcq WHERE trim(subject_name) <> '' AND trim(topic_name) <> '' GROUP BY 1, 2")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled sentences in a Latin-1 file whose rows end in a carriage return, and back."""
    path = new_folder(spark, "csv")
    rows = table(spark, folder, "mcq").select(F.trim("subject_name").alias("label"), F.trim("topic_name").alias("sentence")).where("label <> '' and sentence <> ''")
    rows.write.option("lineSep", "\r").option("encoding", "ISO-8859-1").csv(path)
    return stats.count_by(readers.read_labelled_csv(spark, path), "label", "sentence")


@register("SELECT prompt_id, len(rubrics) AS rubrics FROM benchmark_prompt")
def named_split(spark: SparkSession, folder: str) -> DataFrame:
    """One split of a data set of pinned files, with the columns it must have."""
    path = new_folder(spark, "benchmark")
    sinks.write_jsonl(table(spark, folder, "benchmark_prompt"), path)
    rows = readers.read_named(spark, {"test": path}, "test", required=("prompt_id", "prompt", "rubrics", "example_tags"))
    return rows.select("prompt_id", big(F.when(F.col("rubrics").isNotNull(), F.size("rubrics"))).alias("rubrics"))


@register("SELECT count(*) AS n FROM reference_qa")
def config_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A table under whichever spelling of its name is there."""
    return readers.with_fallback(readers.name_variants("Reference-QA"), lambda name: table(spark, folder, name)).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT prompt_id, prompt_response, count(*) AS n FROM (SELECT b.prompt_id, g.response AS prompt_response FROM benchmark_prompt b JOIN (SELECT prompt_id, arg_max(coalesce(response, 'None'), line_no) AS response FROM generation WHERE prompt_id IS NOT NULL GROUP BY prompt_id) g ON b.prompt_id = g.prompt_id) GROUP BY 1, 2")
def judge_file(spark: SparkSession, folder: str) -> DataFrame:
    """Judge rows as JSON lines, and back."""
    path = new_folder(spark, "judge")
    sinks.write_judge_jsonl(judge.judge_rows(table(spark, folder, "benchmark_prompt"), table(spark, folder, "generation")), path)
    rows = readers.read_jsonl(spark, path, f"prompt_id string, prompt_response {M.MESSAGES}")
    return stats.count_by(rows.select("prompt_id", F.get("prompt_response", 0).content.alias("prompt_response")), "prompt_id", "prompt_response")


@register("SELECT gold_label, pred_label, count(*) AS n FROM (SELECT ['negative', 'neutral', 'positive'][band % 3 + 1] AS gold_label, ['negative', 'neutral', 'positive'][CAST(doc_id % 3 AS INT) + 1] AS pred_label FROM reading_labels WHERE band IS NOT NULL) GROUP BY 1, 2")
def evaluation_files(spark: SparkSession, folder: str) -> DataFrame:
    """What an evaluated classifier leaves: three documents and its predictions, which are read back."""
    out = new_folder(spark, "evaluation")
    rows = table(spark, folder, "reading_labels").where("band is not null").select((F.col("band") % 3).cast("int").alias("gold_label_id"), (F.col("doc_id") % 3).cast("int").alias("pred_label_id"))
    sinks.write_evaluation(rows, out)
    return stats.count_by(spark.read.schema("gold_label_id int, gold_label string, pred_label_id int, pred_label string").option("header", True).csv(f"{out}/predictions.csv"), "gold_label", "pred_label")


@register("SELECT event_type AS tag, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS steps, round(sum(value::FLOAT::DOUBLE), 4) AS total FROM events GROUP BY event_type")
def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Scalars framed as training event logs, one file's bytes a row, and read again."""
    rows = table(spark, folder, "events").select("event_type", "event_id", F.unix_timestamp("ts").cast("double").alias("wall"), "value")
    log = readers.event_log_rows(readers.as_event_logs(rows, "event_type", "event_id", "wall", "value"))
    return log.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"), F.round(F.sum("value"), 4).alias("total"))

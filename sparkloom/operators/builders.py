"""Raw rows to training examples: (pos, split, source, task, messages, meta fields, id).

Every builder is one projection under an ordered chain of conditions; a row that fails
one is left out. Cheap conditions stand before the text is cleaned, so Catalyst can push
them down. Null and missing texts count as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import patterns as P
from sparkloom.functions import text as X
from sparkloom.functions.messages import computed, conversation, example_id, is_valid_dialogue, is_valid_pair, last_turns, merge_turns, message, normalize_messages, with_system
from sparkloom.plans.config import DialogueRules, Lengths


def _finish(rows: DataFrame, source: str, task: str, messages: Column, keep: list[str], **meta: Column) -> DataFrame:
    """Examples of rows, with their id and meta fields."""
    built = rows.select(*keep, F.lit(source).alias("source"), F.lit(task).alias("task"), messages.alias("messages"), F.struct(*[c.alias(k) for k, c in meta.items()]).alias("meta") if meta else F.lit(None).alias("meta"))
    return built.withColumn("id", example_id(F.col("source"), F.col("task"), F.col("messages")))


def _pair(system: str | None, user: Column, assistant: Column) -> Column:
    return conversation(system, message("user", user), message("assistant", assistant))


def choice_examples(rows: DataFrame, keep: list[str], lengths: Lengths = Lengths(), system: str | None = P.REFERENCE_SYSTEM, nfkc: bool = True, source: str = "choice", task: str = "choice_explained") -> DataFrame:
    """Single-choice questions with an explanation: question, four options, correct index.

    Rows with another choice type than 'single' or blank, a blank question, explanation or
    option, or no readable answer are left out.
    """
    c = lambda name: X.clean_text(F.col(name), nfkc)
    kind = F.lower(c("choice_type"))
    made = computed(
        rows.where(kind.isin("", "single")),
        {
            "_question": X.truncate_at_word(c("question"), lengths.question),
            "_explanation": X.choice_explanation(F.col("exp"), lengths.explanation, nfkc),
            "_options": F.array(c("opa"), c("opb"), c("opc"), c("opd")),
            "_answer": X.choice_index(F.col("cop"), nfkc),
        },
    )
    made = made.where((F.col("_question") != "") & (F.col("_explanation") != "") & F.forall("_options", lambda o: o != "") & F.col("_answer").isNotNull())
    options = [F.concat(F.lit(f"\n{'ABCD'[i]}. "), F.get("_options", i)) for i in range(4)]
    user = F.concat(F.lit(P.CHOICE_LEAD + "Question: "), F.col("_question"), *options)
    assistant = F.concat(F.lit("Explanation: "), F.col("_explanation"), F.lit("\n\nFinal answer: "), X.option_label(F.col("_answer")), F.lit(". "), F.get("_options", F.col("_answer")))
    made = computed(made, {"_user": user, "_assistant": assistant}).where(is_valid_pair(F.col("_user"), F.col("_assistant"), lengths.least_user, lengths.least_assistant))
    return _finish(made, source, task, _pair(system, F.col("_user"), F.col("_assistant")), keep, subject_name=c("subject_name"), topic_name=c("topic_name"), answer_idx=F.col("_answer"))


def reference_examples(
    rows: DataFrame, keep: list[str], lengths: Lengths = Lengths(), system: str | None = P.REFERENCE_SYSTEM, nfkc: bool = True,
    excluded_sources: tuple[str, ...] = P.EXCLUDED_SOURCES, excluded_types: tuple[str, ...] = P.EXCLUDED_QUESTION_TYPES, source: str = "reference", task: str = "reference_qa",
) -> DataFrame:
    """Reference questions and answers; sources are excluded as spelled, question types whatever their case."""
    c = lambda name: X.clean_text(F.col(name), nfkc)
    made = computed(rows, {"_source": c("document_source"), "_type": F.lower(c("question_type"))})
    made = made.where(~F.col("_source").isin(*excluded_sources) & ~F.col("_type").isin(*excluded_types))
    made = computed(made, {"_user": c("question"), "_assistant": X.truncate_at_word(c("answer"), lengths.reference_answer)})
    made = made.where(is_valid_pair(F.col("_user"), F.col("_assistant"), lengths.least_user, lengths.least_assistant))
    return _finish(
        made, source, task, _pair(system, F.col("_user"), F.col("_assistant")), keep,
        document_source=F.col("_source"), question_type=F.col("_type"), question_focus=c("question_focus"), document_id=c("document_id"),
    )


def notes_examples(rows: DataFrame, keep: list[str], lengths: Lengths = Lengths(), dialogue: bool = False, nfkc: bool = True, source: str = "notes", task: str | None = None) -> DataFrame:
    """Topic, input and output with footers: short reference answers.

    ``dialogue`` gives the form for dialogue mixtures: openings of answerers are left out,
    and a topic that normalises to nothing isn't set before the input. ``task`` is named by
    the form unless it is given.
    """
    c = lambda name: X.clean_text(F.col(name), nfkc)
    made = computed(rows, {"_topic": c("instruction"), "_input": X.truncate_at_word(c("input"), lengths.notes_input), "_assistant": X.strip_footer(F.col("output"), lengths.notes_output, nfkc)})
    made = computed(made.where(F.col("_assistant") != ""), {"_user": X.topic_prompt(F.col("_topic"), F.col("_input"), unlabelled_when_blank=dialogue)})
    made = made.where(is_valid_pair(F.col("_user"), F.col("_assistant"), lengths.least_user, lengths.least_assistant))
    if dialogue:
        made = made.where(~X.is_provider_opening(F.col("_user"), False))
        return _finish(made, source, task or "single_turn_reference", _pair(P.CONSULT_SYSTEM, F.col("_user"), F.col("_assistant")), keep, instruction=F.col("_topic"), n_messages=F.lit(2))
    return _finish(made, source, task or "reference_qa", _pair(P.REFERENCE_SYSTEM, F.col("_user"), F.col("_assistant")), keep, instruction=F.col("_topic"))


def task_examples(rows: DataFrame, keep: list[str], lengths: Lengths = Lengths(), nfkc: bool = True, source: str = "task", task: str = "instruction") -> DataFrame:
    """Instructions with an input and output that aren't about extraction, tables or code."""
    c = lambda name: X.clean_text(F.col(name), nfkc)
    made = computed(rows, {"_instruction": c("instruction"), "_input": X.truncate_at_word(c("input"), lengths.task_input), "_assistant": X.truncate_at_word(c("output"), lengths.task_output)})
    made = computed(made.where(~X.is_extraction_task(F.col("_instruction"), F.col("_assistant"))), {"_user": X.labelled_prompt(F.col("_instruction"), F.col("_input"))})
    made = made.where(is_valid_pair(F.col("_user"), F.col("_assistant"), lengths.least_user, lengths.least_assistant))
    return _finish(made, source, task, _pair(P.REFERENCE_SYSTEM, F.col("_user"), F.col("_assistant")), keep)


def general_examples(rows: DataFrame, keep: list[str], lengths: Lengths = Lengths(), nfkc: bool = True, source: str = "general", task: str = "general_instruction") -> DataFrame:
    """General instructions with context, response and category, without code and unsafe matters."""
    c = lambda name: X.clean_text(F.col(name), nfkc)
    made = computed(rows, {"_instruction": c("instruction"), "_input": X.truncate_at_word(c("context"), lengths.general_input), "_assistant": X.truncate_at_word(c("response"), lengths.general_output)})
    made = computed(made.where(X.is_plain_general(F.concat_ws("\n", "_instruction", "_input"), F.col("_assistant"))), {"_user": X.labelled_prompt(F.col("_instruction"), F.col("_input"))})
    made = made.where(is_valid_pair(F.col("_user"), F.col("_assistant"), lengths.least_user, lengths.least_assistant))
    return _finish(made, source, task, _pair(P.GENERAL_SYSTEM, F.col("_user"), F.col("_assistant")), keep, category=c("category"))


def dialogue_examples(rows: DataFrame, keep: list[str], source: str, task: str, rules: DialogueRules, system: str | None = P.CONSULT_SYSTEM, nfkc: bool = True) -> DataFrame:
    """Dialogues with even roles: neighbours merged, cut to the last messages, from a user to the assistant. Rows without messages are left out."""
    made = computed(rows.where(F.col("messages").isNotNull()), {"_turns": last_turns(merge_turns(normalize_messages(F.col("messages"), nfkc)), rules.most_messages)})
    made = made.where((F.size("_turns") >= rules.least_messages) & is_valid_dialogue(F.col("_turns"), rules.least_user, rules.least_assistant))
    if rules.drop_provider_openings:
        made = made.where(~X.is_provider_opening(F.get("_turns", 0).content, False))
    return _finish(made, source, task, with_system(system, F.col("_turns")), keep, orig_id=F.col("id").cast("string"), n_messages=F.size("_turns"))


def followup_examples(rows: DataFrame, keep: list[str], rules: DialogueRules = DialogueRules(), nfkc: bool = True, source: str = "followup", task: str = "ask_followup") -> DataFrame:
    """Follow-up questions: from ``messages`` where there is a list, else from ``context`` and ``question`` if both have something in them."""
    c = lambda name: X.clean_text(F.col(name), nfkc)
    made = computed(rows, {"_context": c("context"), "_question": c("question")})
    own = F.when((F.col("_context") != "") & (F.col("_question") != ""), F.array(message("user", F.col("_context")), message("assistant", F.col("_question"))))
    made = computed(made, {"_raw": F.when(F.col("messages").isNotNull(), normalize_messages(F.col("messages"), nfkc)).otherwise(own)}).where("_raw is not null")
    made = computed(made, {"_turns": last_turns(merge_turns(F.col("_raw")), rules.most_messages)})
    made = made.where(is_valid_dialogue(F.col("_turns"), rules.least_user, rules.least_assistant) & ~X.is_provider_opening(F.get("_turns", 0).content, False))
    return _finish(made, source, task, with_system(P.FOLLOWUP_SYSTEM, F.col("_turns")), keep, orig_id=F.col("id").cast("string"), n_messages=F.size("_turns"))

"""The history of each conversation as streaming state, beside its batch form in ``operators.chat``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.chat import EXIT_WORDS

OUTPUT = "conv_id string, turn long, prompt_turns int, prompt string"
STATE = "roles array<string>, texts array<string>, ended boolean"
#: A conversation that says nothing for so long is forgotten.
IDLE_MS = 3_600_000


def _extender(idle_ms: int, most_turns: int | None):  # noqa: ANN202
    def extend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, texts, ended = state.get if state.exists else ([], [], False)
        roles, texts = list(roles), list(texts)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            text = (text or "").strip()
            if ended or not text:
                continue
            if text.lower() in EXIT_WORDS:
                ended, roles, texts = True, [], []
                continue
            roles.append(role)
            texts.append(text)
            if most_turns is not None:
                roles, texts = roles[-most_turns:], texts[-most_turns:]
            out.append((key[0], int(turn), len(texts), "".join(f"{r}: {t}\n" for r, t in zip(roles, texts))))
        state.update((roles, texts, ended))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "prompt_turns", "prompt"])

    return extend


def streaming_histories(lines: DataFrame, idle_ms: int = IDLE_MS, most_turns: int | None = None) -> DataFrame:
    """(conv_id, turn, prompt_turns, prompt) for each line of a stream of (conv_id, turn, role, text): its conversation said so far.

    Blank lines are skipped; an exit word ends a conversation. Lines of a conversation
    that come in one batch are taken by turn. The state is the turns of a conversation,
    or the last ``most_turns``; it goes after ``idle_ms`` without a line. Timeouts keep a
    query busy with batches without data: a run that should end once all is read sets
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    """
    rows = lines.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), "role", "text")
    return rows.groupBy("conv_id").applyInPandasWithState(_extender(idle_ms, most_turns), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Rows and sums per event type in event-time windows; rows later than ``delay`` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")

"""Keep-first deduplication within and across sources, as windows.

A signature of a third of all rows (the empty one, for one) is a hot group. A plain
``rank = 1`` filter makes Spark keep one row per group and task before the shuffle, so
such a group shrinks to one row a task. The two-rule form is made of such filters too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group; nulls form a group of their own. ``order`` should leave no ties, else any of the tied rows is kept."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def priority_of(source: Column, priority: Sequence[str]) -> Column:
    """The place of a source in a list of falling priority; unknown sources come last."""
    if not priority:
        return F.lit(1)
    place = F.array_position(F.array(*map(F.lit, priority)), source)
    return F.when(place > 0, place).otherwise(len(priority) + 1)


def dedup_pool(rows: DataFrame, pos: str = "pos", user: str = "user_sig", within: Sequence[str] = ("split",)) -> DataFrame:
    """The first row, by ``pos``, of each first question. Equal whole dialogues have equal first questions, so that rule covers them."""
    return first_per_group(rows, [*within, user], [pos])


def dedup_by_priority(rows: DataFrame, priority: Sequence[str], pos: str = "pos", user: str = "user_sig", source: str = "source", within: Sequence[str] = ("split",)) -> DataFrame:
    """As :func:`dedup_pool` over all sources, those of higher priority first."""
    return first_per_group(rows, [*within, user], [priority_of(F.col(source), priority), pos])


def dedup_lenient_strict(
    rows: DataFrame, priority: Sequence[str], lenient: Sequence[str], pos: str = "pos", user: str = "user_sig", full: str = "full_sig", source: str = "source", within: Sequence[str] = ("split",)
) -> DataFrame:
    """Deduplication in which some sources of highest priority may share a first question.

    Rows of lenient sources go only if an equal dialogue came before; rows of the others
    also if their first question did, in any source. Lenient sources must come first in
    the priority. Null signatures group together.
    """
    if list(priority[: len(lenient)]) != [s for s in priority if s in set(lenient)]:
        raise ValueError("lenient sources come first in the priority")
    is_lenient = F.col(source).isin(*lenient) if lenient else F.lit(False)
    order = [priority_of(F.col(source), priority), pos]
    keep_lenient = first_per_group(rows.where(F.coalesce(is_lenient, F.lit(False))), [*within, full], order)
    strict = first_per_group(rows.where(~F.coalesce(is_lenient, F.lit(False))), [*within, user], order)
    seen = keep_lenient.select(*within, user).distinct()
    same = [strict[c].eqNullSafe(seen[c]) for c in (*within, user)]
    return keep_lenient.unionByName(strict.join(seen, same, "left_anti"))


def drop_exact_duplicates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each combination of ``columns``, which are all that is kept."""
    return rows.select(*columns).distinct()


def without_conflicts(rows: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Rows whose text has one label only. A null label counts as none."""
    clashing = rows.groupBy(text).agg(F.min(label).alias("_least"), F.max(label).alias("_most")).where("_least <> _most").select(text)
    return rows.join(clashing, text, "left_anti")

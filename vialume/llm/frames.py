"""Frames with further columns of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Tasks for each core in a stage over small rows.
TASKS_A_CORE = 8


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """The same rows, partitions handled one after another in at most ``TASKS_A_CORE`` tasks a core: for small rows, of which
    many shuffle partitions cost more to start and to write than to work on. No rows move, and partitions stay as they are dealt."""
    return rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def own_names(docs: DataFrame, known: tuple[str, ...] = KNOWN) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns that operators don't read renamed by place, and the names it had.

    So no further column can clash with one that an operator adds, nor with another of the same name.
    """
    seen: set[str] = set()
    names = []
    for i, c in enumerate(docs.columns):
        names.append(c if c in known and c not in seen else f"c{i}")
        seen.add(c)
    return docs.toDF(*names), list(docs.columns)

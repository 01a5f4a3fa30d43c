"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: So many tasks for each core, and at least so many.
TASKS_A_CORE, LEAST_TASKS = 3, 12


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt to all cores, by these keys if there are any.  A small file is one task, however much work its rows
    are.  A stream is left as it is."""
    if rows.isStreaming:
        return rows
    tasks = max(LEAST_TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)

"""Grouping: the columns that stand for a segment's group."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.model import Task


def grouped(df: DataFrame, task: Task) -> tuple[DataFrame, list[str]]:
    """df and its grouping columns. A key is a column or several; missing is null, and null is a group. A function of
    the DataFrame's columns gives the column group_key."""
    if task.group_by_fn is not None:
        return df.withColumn("group_key", task.group_by_fn(df)), ["group_key"]
    if task.group_by_key is None:
        return df, []
    return df, [task.group_by_key] if isinstance(task.group_by_key, str) else list(task.group_by_key)

"""Operators over whole bounded inputs, as optional task functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import shared


def remove(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def sample(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def reduce_by_key(df: DataFrame, keys: Sequence[str], **states: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in states.items()))


def sort(df: DataFrame, *by: str) -> DataFrame:
    return df.orderBy(*by)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(keys), how)


def cogroup(a: DataFrame, b: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)


def cartesian(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs: meant for small inputs, as its name says."""
    return a.crossJoin(b)


def iterate(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], rounds: int = 100) -> DataFrame:
    """step until done, at most so many rounds; each round's result is checkpointed in spark.checkpoint.dir, or where
    that is unset, on a single machine, in a folder of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared.folder(df.sparkSession, "rounds"))
    for _ in range(rounds):
        if done(df):
            break
        df = step(df).checkpoint()
    return df

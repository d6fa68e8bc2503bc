"""Work that needs a group's rows in order: folds over sorted tasks, and running aggregates in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Log2 of the length of the stretches of an integer order (microseconds: of 2^36) in which a group is worked on.
STRETCH = 18
#: Rows that a task hands on at once.
BATCH = 1000


def stretch(df: DataFrame, seq: str) -> Column | None:
    """The number of the stretch of seq that a row is in, a long; None where seq is neither an integer nor a time."""
    kind = df.schema[seq].dataType
    if isinstance(kind, T.IntegralType):
        return F.shiftright(F.col(seq).cast("long"), STRETCH)
    return F.shiftright(F.unix_micros(F.col(seq)), 36) if isinstance(kind, T.TimestampType) else None


def match(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined with b where their keys are equal, nulls too; columns as in a join by names."""
    b = b.withColumnsRenamed({k: f"__same{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__same{i}"))
    return a.join(b, same, how).drop(*(f"__same{i}" for i in range(len(keys))))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: T.StructType, begin: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list[dict]]], end: Callable[[Any], list[dict]]) -> DataFrame:
    """Each group's rows, as dicts in order, through a fold: step gives the next state and rows to hand on, end the last rows.
    A task sorts its groups (Spark spills) and holds one state at a time. The keys are put before what the fold makes."""
    whole = T.StructType([*(df.schema[k] for k in keys), *schema.fields])
    arrow, keys = to_arrow_schema(whole), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, state, out = None, {}, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple("nan" if row[k] != row[k] else row[k] for k in keys)
                if last is None or key != last:
                    if last is not None:
                        out += [head | r for r in end(state)]
                    last, head, state = key, {k: row[k] for k in keys}, begin()
                state, made = step(state, row)
                out += [head | r for r in made]
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if last is not None:
            out += [head | r for r in end(state)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    placed = df.repartition(*keys) if keys else df.repartition(1)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, whole)


def running(df: DataFrame, keys: Sequence[str], seq: str, states: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running aggregates (name -> ("sum", "min" or "max", value)) over the rows of its keys' group in the order of
    seq, the row itself included.

    A group is cut in stretches of seq. Rows are sorted within their stretch alone, and what comes before it is
    a running aggregate over one row a stretch, so no group, nor the table where there are no keys, is one task's.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    number = stretch(df, seq)
    if number is None:
        return df.withColumns({n: fold[k](c).over(upto(W.partitionBy(*keys).orderBy(seq))) for n, (k, c) in states.items()})
    cut = df.withColumn("__b", number)
    parts = cut.groupBy(*keys, "__b").agg(*(fold[k](c).alias(f"__p_{n}") for n, (k, c) in states.items()))
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(*keys, "__b", *(fold[k](f"__p_{n}").over(earlier).alias(f"__q_{n}") for n, (k, _) in states.items()))
    own = cut.withColumns({f"__r_{n}": fold[k](c).over(upto(W.partitionBy(*keys, "__b").orderBy(seq))) for n, (k, c) in states.items()})
    both = match(own, before, [*keys, "__b"])
    total = {}
    for n, (k, _) in states.items():
        a, b = F.col(f"__q_{n}"), F.col(f"__r_{n}")
        total[n] = F.coalesce(a + b, a, b) if k == "sum" else F.least(a, b) if k == "min" else F.greatest(a, b)
    return both.withColumns(total).select(*df.columns, *states)

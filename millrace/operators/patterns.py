"""What jobs of this kind usually do by hand: joins, lookups, dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.model import Window
from millrace.operators.windows import BOUNDS, aggregate, key_ms, with_extents

#: Bytes up to which lookup() broadcasts its table.
BROADCAST = 64 << 20


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of a DataFrame's bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def pair_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two inputs merged by key, where a key occurs once on each side."""
    return a.join(b, list(keys))


def pair_arrivals(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Consecutive arrivals of a key, the 1st and 2nd, 3rd and 4th and so on, merged; of a field that both have,
    the later one counts, where it is not null. One without a partner yet gives no row."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(seq)) - 1
    pairs = df.withColumn("__p", F.floor(place / 2))
    rest = [c for c in df.columns if c not in keys]
    merged = pairs.groupBy(*keys, "__p").agg(F.count("*").alias("__n"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))
    return merged.where("__n = 2").select(*keys, *rest)


def windowed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], window: Window) -> DataFrame:
    """Pairs of segments of two inputs with equal keys in the same extent, with its bounds. Sessions are those of
    both inputs' keys together. Other columns must differ in name."""
    if window.type == "session":
        both = a.select(*keys, window.window_key).union(b.select(*keys, window.window_key))
        spans = aggregate(both, Window("w", window.task, "session", "count", window_key=window.window_key, timeout_gap=window.timeout_gap), keys).drop("state")
        at = lambda df: df.withColumn("__t", key_ms(df, window.window_key)).join(spans, [*keys]).where(F.col("__t").between(F.col("lower_ms"), F.col("upper_ms"))).drop("__t")
        return at(a).join(at(b).drop(window.window_key), [*keys, *BOUNDS])
    b = with_extents(b, window, keys)
    b = b if window.window_key is None else b.drop(window.window_key)
    a = with_extents(a, window, keys)
    return a.join(b.drop(*BOUNDS), list(keys)) if window.type == "global" else a.join(b, [*keys, *BOUNDS])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Enrichment from a table, broadcast where its estimated size is below BROADCAST; else joined by shuffle."""
    return df.join(F.broadcast(table) if size_of(table) <= BROADCAST else table, list(keys), how)


def dedupe(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The first arrival of each key. The earliest row is found by a partial aggregation, not by sorting a group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("__r")).select(*keys, "__r.*")

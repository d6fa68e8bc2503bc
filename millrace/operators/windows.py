"""Windows: extents as inclusive integer bounds (milliseconds, or any integer domain), and aggregation over them.

lower_ms and upper_ms are longs, inclusive at both ends, whatever the unit. Sliding extents are aligned by
their ends, and all are clipped at min_value.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import Window
from millrace.operators.aggregations import Aggregation, columns_of
from millrace.operators.sorted import fold_sorted, stretch
from millrace.units import standard

BOUNDS = ("lower_ms", "upper_ms")


def key_ms(df: DataFrame, key: str) -> Column:
    """The window key as a long: timestamps as milliseconds since 1970, integers as they are."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_millis(F.col(key).cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("long")
    raise TypeError(f"a window key is a time or an integer; {key} is {kind.simpleString()}")


def window_ids(t: Column, range_: int, slide: int, least: int = 0) -> tuple[Column, Column]:
    """First and last window number of a key: (t-m)/s .. (t+r-m)/s - 1, rounded down."""
    return F.floor((t - least) / slide).cast("long"), (F.floor((t + range_ - least) / slide) - 1).cast("long")


def bounds(w: Column, range_: int, slide: int, least: int = 0) -> tuple[Column, Column]:
    return F.greatest(F.lit(least).cast("long"), w * slide + (least + slide - range_)), w * slide + (least + slide - 1)


def with_extents(df: DataFrame, window: Window, groups: Sequence[str] = ()) -> DataFrame:
    """df with lower_ms and upper_ms: a row for each extent that a segment is in. Null keys are in none."""
    if window.type == "global":
        return df.withColumns({b: F.lit(None).cast("long") for b in BOUNDS})
    t = key_ms(df, window.window_key)
    df = df.where(F.col(window.window_key).isNotNull())
    if window.type == "session":
        return _sessions(df, t, standard(window.timeout_gap)[0], groups)
    range_ = standard(window.range)[0]
    slide = range_ if window.type == "fixed" else standard(window.slide or window.range)[0]
    first, last = window_ids(t, range_, slide, window.min_value)
    df = df.withColumn("__w", first if window.type == "fixed" else F.explode(F.when(first <= last, F.sequence(first, last))))
    lower, upper = bounds(F.col("__w"), range_, slide, window.min_value)
    return df.withColumns({"lower_ms": lower, "upper_ms": upper}).drop("__w")


def _sessions(df: DataFrame, t: Column, gap: int, groups: Sequence[str]) -> DataFrame:
    """Sessions, for any integer key: a segment more than gap after the one before it begins a new one.

    Ungrouped, all of a table is one group; it is then split at stretches of keys (2^12 gaps each) whose sessions are
    found apart, and a session that crosses a border is joined to its neighbour by a pass over the
    stretches' ends alone.
    """
    df = df.withColumn("__t", t)
    if groups:
        own = W.partitionBy(*groups).orderBy("__t")
        df = df.withColumn("__new", F.coalesce((F.col("__t") - F.lag("__t").over(own) > gap).cast("int"), F.lit(1)))
        df = df.withColumn("__s", F.sum("__new").over(own))
        same = W.partitionBy(*groups, "__s")
    else:
        df = df.withColumn("__b", F.floor(F.col("__t") / (gap * 4096)).cast("long"))
        ends = df.groupBy("__b").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
        before = ends.withColumn("__last", F.max("__hi").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).select("__b", "__last")
        df = df.join(before, "__b", "left")
        own = W.partitionBy("__b").orderBy("__t")
        df = df.withColumn("__new", (F.col("__t") - F.coalesce(F.lag("__t").over(own), F.col("__last")) > gap).cast("int"))
        df = df.withColumn("__start", F.max(F.when(F.coalesce("__new", F.lit(1)) == 1, F.col("__t"))).over(own))
        starts = df.groupBy("__b").agg(F.max("__start").alias("__start"))
        carried = starts.withColumn("__carry", F.last("__start", True).over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).select("__b", "__carry")
        df = df.join(carried, "__b", "left").withColumn("__s", F.coalesce("__start", "__carry")).drop("__b", "__last", "__start", "__carry")
        same = W.partitionBy("__s")
    return df.withColumns({"lower_ms": F.min("__t").over(same), "upper_ms": F.max("__t").over(same)}).drop("__t", "__new", "__s")


def aggregate(df: DataFrame, window: Window, groups: Sequence[str] = (), seq: Sequence[str] = ()) -> DataFrame:
    """The final state of every extent: groups, lower_ms, upper_ms and the state's columns.

    The extents of fixed, sliding and global windows are columns, so Spark sums up before it shuffles; sessions over
    times use session_window, which merges sessions as it aggregates. The storage strategy "ordered-log" puts segments in
    the order of the window key, then of seq; "extents" alone keeps the bounds and no state.
    """
    if "ordered-log" in window.storage_strategy and window.window_key is not None:
        seq = [window.window_key, *(s for s in seq if s != window.window_key)]
    if set(window.storage_strategy) == {"extents"}:
        return with_extents(df, window, groups).select(*groups, *BOUNDS).distinct()
    columns = [c for c in df.columns if c not in BOUNDS]
    keys = [*groups, *BOUNDS]
    if isinstance(window.aggregation, Aggregation):
        return _folded(with_extents(df, window, groups), window, keys, columns, seq)
    if window.type == "session" and groups and not isinstance(df.schema[window.window_key].dataType, T.IntegralType):
        return _time_sessions(df, window, groups, columns, seq)
    df = with_extents(df, window, groups)
    name, key = (window.aggregation, None) if isinstance(window.aggregation, str) else window.aggregation
    if name == "collect-by-key":
        inner = df.groupBy(*keys, F.col(key).alias("__k")).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("__v"))
        state = F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v"))))
        return inner.where("__k is not null").groupBy(*keys).agg(state.alias("state"))
    state = columns_of(window.aggregation, window.init, columns, seq)
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in state.items()))


def _time_sessions(df: DataFrame, window: Window, groups: Sequence[str], columns: Sequence[str], seq: Sequence[str]) -> DataFrame:
    gap = standard(window.timeout_gap)[0]
    df = df.where(F.col(window.window_key).isNotNull()).withColumn("__ts", F.timestamp_millis(key_ms(df, window.window_key)))
    session = F.session_window("__ts", f"{gap} milliseconds")
    name, key = (window.aggregation, None) if isinstance(window.aggregation, str) else window.aggregation
    if name == "collect-by-key":
        state = {"__all": F.collect_set(F.struct(F.col(key).alias("k"), F.struct(*columns).alias("v")))}
    else:
        state = columns_of(window.aggregation, window.init, columns, seq)
    out = df.groupBy(*groups, session.alias("__w")).agg(*(c.alias(n) for n, c in state.items()))
    if name == "collect-by-key":
        ks = F.array_sort(F.array_distinct(F.transform("__all", lambda x: x["k"])))
        entry = lambda k: F.struct(k.alias("key"), F.array_sort(F.transform(F.filter("__all", lambda x: x["k"] == k), lambda x: x["v"])).alias("value"))
        out = out.withColumn("state", F.map_from_entries(F.transform(F.filter(ks, lambda k: k.isNotNull()), entry)))
        state = {"state": None}
    lower, upper = F.unix_millis("__w.start"), F.unix_millis("__w.end") - gap
    return out.select(*groups, lower.alias("lower_ms"), upper.alias("upper_ms"), *state)


def _folded(df: DataFrame, window: Window, keys: Sequence[str], columns: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """A user's aggregation: each extent's segments, in order, through its fold.

    With a merge, an extent is folded in stretches of the first of seq (without seq: in the tasks' own shares) whose
    states merge in order, so a large extent is spread over tasks. Without one, one task folds it, a row at a time.
    """
    own: Aggregation = window.aggregation
    fresh = lambda: own.init() if own.init else window.init
    only = lambda r: {c: r[c] for c in columns}
    state = T.StructType.fromDDL(f"state {own.schema}")
    part = (stretch(df, seq[0]) if seq else F.spark_partition_id()) if own.merge else None
    if part is None:
        return fold_sorted(df, keys, seq, state, fresh, lambda s, r: (own.apply(s, own.create(only(r))), []), lambda s: [{"state": s}])
    packed = T.StructType.fromDDL("__state binary")
    parts = fold_sorted(df.withColumn("__b", part), [*keys, "__b"], seq, packed, fresh, lambda s, r: (own.apply(s, own.create(only(r))), []), lambda s: [{"__state": pickle.dumps(s)}])

    def join(s: list, r: dict) -> tuple[list, list]:
        more = pickle.loads(r["__state"])
        return [own.merge(s[0], more) if s else more], []

    return fold_sorted(parts, keys, ["__b"], state, list, join, lambda s: [{"state": s[0]}])

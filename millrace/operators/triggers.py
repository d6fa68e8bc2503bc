"""Triggers over bounded data: what would have been released, and when, from window functions alone.

Every segment has a place in the order of arrival, `seq`. The state that a trigger sees is a running aggregate over
an extent's segments. Fires are told by fire_seq (the segment that fired) or, at completion, null.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.model import Trigger, Window
from millrace.operators.aggregations import columns_of
from millrace.operators.sorted import fold_sorted, match, running
from millrace.operators.windows import BOUNDS, aggregate, key_ms, with_extents
from millrace.streaming.fold import Fold, Group
from millrace.units import standard


def _fires(window: Window, trigger: Trigger) -> Column:
    """Whether a segment fires the trigger for an extent that it is in; __rn counts the group's segments from 1."""
    if trigger.on == "segment":
        return F.col("__rn") % standard(trigger.threshold)[0] == 0
    if trigger.on == "punctuation":
        return F.coalesce(trigger.pred(F.col("__rn")), F.lit(False))
    if trigger.on == "percentile-watermark":
        return F.col("__t") >= F.col("lower_ms") + trigger.watermark_percentage * (F.col("upper_ms") - F.col("lower_ms"))
    raise ValueError(f"{trigger.on} triggers fire by time, not by segments: use final_state() or streaming")


def _running_state(rows: DataFrame, window: Window, extent: Sequence[str], seq: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """rows with the state that their extent has after them, in columns __s_<name>, and these names."""
    name, key = (window.aggregation, None) if isinstance(window.aggregation, str) else window.aggregation
    s = lambda n: F.col(f"__s_{n}")
    if name == "count":
        return running(rows, extent, seq, {"__s_state": ("sum", F.lit(1).cast("long"))}), ["state"]
    if name == "sum":
        return running(rows, extent, seq, {"__s_state": ("sum", F.col(key))}).withColumn("__s_state", F.coalesce(s("state"), F.lit(0))), ["state"]
    if name in ("min", "max"):
        pick = F.least if name == "min" else F.greatest
        return running(rows, extent, seq, {"__s_state": (name, F.col(key))}).withColumn("__s_state", pick(F.lit(window.init), s("state"))), ["state"]
    if name == "average":
        own = running(rows, extent, seq, {"__s_n": ("sum", F.col(key).isNotNull().cast("long")), "__s_sum": ("sum", F.col(key))})
        return own.withColumn("__s_average", F.when(s("n") > 0, s("sum") / s("n"))).withColumn("__s_sum", F.coalesce(s("sum"), F.lit(0))), ["n", "sum", "average"]
    over = W.partitionBy(*extent).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow)
    state = columns_of(window.aggregation, window.init, columns, (seq,), lambda c: c.over(over))
    return rows.withColumns({f"__s_{k}": c for k, c in state.items()}), list(state)


def replay(df: DataFrame, window: Window, trigger: Trigger, groups: Sequence[str] = (), seq: str = "seq", completion: bool = False) -> DataFrame:
    """One row for each fire of each extent: groups, bounds, fire_seq and the state's columns.

    A segment trigger counts the segments of a group, over all its extents. fire_all_extents releases each extent
    that the group has so far; otherwise those of the firing segment. With post_evictor "all" an extent starts anew after
    each fire. completion adds the release of what is there at the end, with a null fire_seq.
    Sessions fire at completion only, as their extents merge until then.
    """
    if trigger.refinement is not None:
        raise ValueError(f"trigger {trigger.id}: a refinement changes the state from fire to fire; use replay_fold()")
    if window.type == "session" or trigger.on == "watermark":
        return final_state(df, window, groups, (seq,))
    columns = [c for c in df.columns if c not in BOUNDS]
    counted = running(df, groups, seq, {"__rn": ("sum", F.lit(1).cast("long"))})
    if window.window_key is not None:
        counted = counted.withColumn("__t", key_ms(counted, window.window_key))
    rows = with_extents(counted, window, groups).withColumn("__fire", _fires(window, trigger))
    extent, n = [*groups, *BOUNDS], standard(trigger.threshold)[0] if trigger.on == "segment" else None
    if trigger.post_evictor == "all":
        if trigger.fire_all_extents and n:
            rows = rows.withColumn("__epoch", F.floor((F.col("__rn") - 1) / n).cast("long"))
        else:
            fired = F.col("__fire").cast("long")
            rows = running(rows, extent, seq, {"__epoch": ("sum", fired)}).withColumn("__epoch", F.col("__epoch") - fired)
        extent = [*extent, "__epoch"]
    own, state = _running_state(rows, window, extent, seq, columns)
    released = [F.col(f"__s_{k}").alias(k) for k in state]
    if not trigger.fire_all_extents:
        out = own.where("__fire").select(*groups, *BOUNDS, F.col(seq).alias("fire_seq"), *released)
        if not completion:
            return out
        end = own.groupBy(*groups, *BOUNDS).agg(F.max_by(F.struct("__fire", *(f"__s_{k}" for k in state)), seq).alias("__end")).select(*groups, *BOUNDS, "__end.*")
        if trigger.post_evictor == "all":
            end = end.where("not __fire")
        return out.union(end.select(*groups, *BOUNDS, F.lit(None).cast(df.schema[seq].dataType).alias("fire_seq"), *released))
    if n is None:
        raise ValueError("fire_all_extents is replayed for segment triggers")
    # The state of each extent at the end of each stretch of n segments, carried on to later fires of the group.
    ends = own.withColumn("__k", F.ceil(F.col("__rn") / n).cast("long"))
    at = W.partitionBy(*extent, "__k").orderBy(F.desc(seq))
    ends = ends.withColumn("__last", F.row_number().over(at)).where("__last = 1")
    total = counted.groupBy(*groups).agg(F.floor(F.count("*") / n).cast("long").alias("__fires"))
    fired = counted.where(F.col("__rn") % n == 0).select(*groups, F.col(seq).alias("fire_seq"), (F.col("__rn") / n).cast("long").alias("__fire_k"))
    if trigger.post_evictor == "all":
        spans = ends.withColumn("__to", F.col("__k"))
    else:
        nxt = F.lead("__k").over(W.partitionBy(*extent).orderBy("__k"))
        spans = ends.withColumn("__next", nxt)
        spans = match(spans, total, groups, "left") if groups else spans.crossJoin(F.broadcast(total))
        spans = spans.withColumn("__to", F.coalesce(F.col("__next") - 1, F.col("__fires")))
    spans = spans.where("__k <= __to").withColumn("__fire_k", F.explode(F.sequence("__k", "__to")))
    out = match(spans.select(*groups, *BOUNDS, "__fire_k", *released), fired, [*groups, "__fire_k"])
    out = out.select(*groups, *BOUNDS, "fire_seq", *state)
    if not completion:
        return out
    last = W.partitionBy(*groups, *BOUNDS).orderBy(F.desc("__k"))
    end = ends.withColumn("__end", F.row_number().over(last)).where("__end = 1")
    if trigger.post_evictor == "all":
        end = match(end, total, groups) if groups else end.crossJoin(F.broadcast(total))
        end = end.where("__k > __fires")
    return out.union(end.select(*groups, *BOUNDS, F.lit(None).cast(df.schema[seq].dataType).alias("fire_seq"), *released))


def replay_fold(df: DataFrame, window: Window, trigger: Trigger, groups: Sequence[str] = (), seq: str = "seq", completion: bool = False) -> DataFrame:
    """What a stream's processor would release, for triggers that window functions can't tell: custom ones, refinements
    and users' aggregations. groups, bounds, fire_seq and state (JSON), as in streams.

    A group's segments pass through one task in order, one at a time; it holds the group's open extents.
    """
    fold = Fold(window, trigger)
    rows = df
    if window.window_key is not None:
        rows = df.withColumn("__t", key_ms(df, window.window_key)).where("__t is not null")
    schema = T.StructType([*T.StructType.fromDDL("lower_ms long, upper_ms long").fields, T.StructField("fire_seq", df.schema[seq].dataType), *T.StructType.fromDDL("state string").fields])
    told = lambda fired, at: [{"lower_ms": e[0], "upper_ms": e[1], "fire_seq": at, "state": json.dumps(s, default=str)} for e, s in fired]

    def step(group: Group, row: dict) -> tuple[Group, list[dict]]:
        t = row.pop("__t", None)
        return group, told(fold.event(group, {"type": "new-segment", "segment": row, "t": t}), row[seq])

    return fold_sorted(rows, groups, [seq], schema, Group, step, lambda g: told(fold.event(g, {"type": "job-completed"}), None) if completion else [])


def final_state(df: DataFrame, window: Window, groups: Sequence[str] = (), seq: Sequence[str] = ()) -> DataFrame:
    """What a watermark trigger that evicts all releases, once for each extent, and what completion releases."""
    return aggregate(df, window, groups, seq)

"""Windows and triggers with Spark's state store: one processor for every kind."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from millrace import shared
from millrace.model import Trigger, Window
from millrace.operators.windows import key_ms
from millrace.streaming.arrival import ordered
from millrace.streaming.fold import GLOBAL, Fold, Group

#: Spark's setting of the state store, and the one that processors need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Releases, and characters of their states, that a task hands on at once.
ROWS, CHARS = 10_000, 1 << 22


class WindowProcessor(StatefulProcessor):
    """Holds a group's extents in a map and the trigger's own state in a value, pickled, so states keep their types. Late
    segments re-open or update their extents; nothing is dropped. Rows of a batch are taken in the order of seq, one at a
    time, and releases are handed on as they come, so a task holds a group's extents, not its rows."""

    def __init__(self, fold: Fold, seq: str | None, keys: Sequence[str]):
        self.fold, self.seq, self.keys = fold, seq, list(keys)

    def init(self, handle) -> None:
        self.handle = handle
        self.extents = handle.getMapState("extents", "lower long, upper long", "state binary")
        self.own = handle.getValueState("trigger", "state binary")

    def _load(self) -> tuple[Group, dict]:
        """The group, and its extents as they are stored. No extent ends before it begins, so (0, -1) can stand for the
        global one."""
        stored = {GLOBAL if tuple(k) == (0, -1) else tuple(k): bytes(v[0]) for k, v in self.extents.iterator()}
        return Group({e: pickle.loads(s) for e, s in stored.items()}, pickle.loads(bytes(self.own.get()[0])) if self.own.exists() else None), stored

    def _save(self, group: Group, stored: dict) -> None:
        """Writes the extents that changed."""
        at = lambda e: (0, -1) if e == GLOBAL else e
        for e in set(stored) - set(group.extents):
            self.extents.removeKey(at(e))
        for e, s in group.extents.items():
            if (made := pickle.dumps(s)) != stored.get(e):
                self.extents.updateValue(at(e), (made,))
        self.own.update((pickle.dumps(group.trigger),))

    def _frames(self, key: tuple, fired: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """Releases, (seq, extent, state) each, in frames of bounded size; the last may be empty."""
        made, chars = [], 0
        for at, extent, state in fired:
            made.append([*key, *extent, at, json.dumps(state, default=str)])
            chars += len(made[-1][-1])
            if len(made) >= ROWS or chars >= CHARS:
                yield self._frame(made)
                made, chars = [], 0
        yield self._frame(made)

    def _frame(self, made: list[list]) -> pd.DataFrame:
        return pd.DataFrame(made, columns=[*self.keys, "lower_ms", "upper_ms", "fire_seq", "state"])

    def _fired(self, group: Group, rows: Iterator[pd.DataFrame], timers) -> Iterator[tuple]:
        for r in ordered(rows, self.seq):
            t = r.pop("__t", None)
            event = {"type": "new-segment", "segment": r, "t": t, "now": timers.getCurrentProcessingTimeInMs() if self.fold.trigger.on == "timer" else 0}
            for e, s in self.fold.event(group, event):
                yield r.get(self.seq), e, s

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        group, stored = self._load()
        yield from self._frames(key, self._fired(group, rows, timerValues))
        if self.fold.trigger.on == "timer" and group.trigger is not None:
            self.handle.registerTimer(int(group.trigger))
        self._save(group, stored)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        group, stored = self._load()
        fired = self.fold.event(group, {"type": "task-iteration", "now": expiredTimerInfo.getExpiryTimeInMs()})
        self.handle.registerTimer(int(group.trigger))
        self._save(group, stored)
        yield from self._frames(key, ((None, e, s) for e, s in fired))

    def close(self) -> None:
        pass


def unpacked(state: str) -> Column:
    """A column of stored states as JSON."""
    return F.udf(lambda s: json.dumps(pickle.loads(s), default=str), "string", useArrow=True)(state)


def triggered(df: DataFrame, window: Window, trigger: Trigger, groups: Sequence[str], seq: str | None = None) -> DataFrame:
    """Releases of a trigger over a stream (or a table): groups, lower_ms, upper_ms, fire_seq, state (JSON).

    Needs the RocksDB state store. Watermark triggers are Spark's own: see windowed().
    """
    if trigger.on == "watermark":
        raise ValueError("use windowed() for watermark triggers")
    rows = df
    if window.window_key is not None:
        rows = df.withColumn("__t", key_ms(df, window.window_key)).where("__t is not null")
    shape = T.StructType([*(T.StructField(g, df.schema[g].dataType) for g in groups), *T.StructType.fromDDL("lower_ms long, upper_ms long, fire_seq long, state string").fields])
    return rows.groupBy(*groups).transformWithStateInPandas(WindowProcessor(Fold(window, trigger), seq, groups), shape, "Update", "ProcessingTime" if trigger.on == "timer" else "None")


def windowed(df: DataFrame, window: Window, groups: Sequence[str] = (), watermark: str | None = None) -> DataFrame:
    """Count, sum, min, max or average over fixed, sliding or session windows of a stream, by Spark's own operators.

    Without a watermark no late segment is dropped: use complete or update mode. With one, extents are released once,
    when the watermark (the largest key less the delay) has passed their end, and state is bounded: append mode.
    """
    from millrace.operators.aggregations import columns_of
    from millrace.operators.windows import with_extents
    from millrace.units import standard

    state = columns_of(window.aggregation, window.init, df.columns, ())
    if watermark is None and window.type != "session":
        return with_extents(df, window).groupBy(*groups, "lower_ms", "upper_ms").agg(*(c.alias(n) for n, c in state.items()))
    ts = df.withColumn("__ts", F.timestamp_millis(key_ms(df, window.window_key)))
    ts = ts.withWatermark("__ts", watermark) if watermark else ts
    if window.type == "session":
        gap = standard(window.timeout_gap)[0]
        own, shift = F.session_window("__ts", f"{gap} milliseconds"), gap
    else:
        range_ = standard(window.range)[0]
        slide = range_ if window.type == "fixed" else standard(window.slide)[0]
        own, shift = F.window("__ts", f"{range_} milliseconds", f"{slide} milliseconds", f"{(window.min_value - range_) % slide} milliseconds"), 1
    lower, upper = F.unix_millis("w.start"), F.unix_millis("w.end") - shift
    lower = lower if window.type == "session" else F.greatest(lower, F.lit(window.min_value))
    return ts.groupBy(*groups, own.alias("w")).agg(*(c.alias(n) for n, c in state.items())).select(*groups, lower.alias("lower_ms"), upper.alias("upper_ms"), *state)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its results, as Parquet files in the shared folder.

    Each micro-batch writes a folder of its own, anew if it is retried. In complete mode each replaces those before; in
    the others their rows add up. The session's state store provider is set for the run alone.
    """
    spark, root = df.sparkSession, shared.folder(df.sparkSession, name)
    before = spark.conf.get(STORE)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{'all' if mode == 'complete' else epoch}")

    spark.conf.set(STORE, ROCKS)
    try:
        query = df.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{root}/checkpoint").start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
        if checkpoint is None:
            shared.delete(spark, f"{root}/checkpoint")
    if not shared.exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{root}/rows/*")

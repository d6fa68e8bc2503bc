"""Plans a job: one DataFrame for each edge, built in the order of the workflow. Nothing runs here."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import resolve
from millrace.model import Job, Task, Trigger
from millrace.model import Window as JobWindow
from millrace.operators import flow, triggers
from millrace.operators.aggregations import Aggregation
from millrace.operators.grouping import grouped
from millrace.operators.transform import ERROR, OLD, segments
from millrace.streaming import processors
from millrace.streaming.fold import CustomTrigger
from millrace.units import standard
from millrace.validate import validate


@dataclass
class Plan:
    edges: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    fired: dict[tuple[str, str], DataFrame] = field(default_factory=dict)  # (window, trigger) -> releases


def merge(frames: list[DataFrame]) -> DataFrame:
    """Fan-in: all rows of all inputs; a field that one lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def apply_fn(df: DataFrame, task: Task, params: tuple, capture: bool, keep_old: bool) -> DataFrame:
    fn = resolve(task.fn)
    if fn is None:
        return df.withColumn(OLD, F.struct(*df.columns)) if keep_old else df
    if task.schema is not None:
        return segments(df, fn, params, task.schema, task.batch_fn, task.batch_size, capture, keep_old)
    if not keep_old:
        return fn(*params, df)
    out = fn(*params, df.withColumn(OLD, F.struct(*df.columns)))
    if OLD not in out.columns:
        raise ValueError(f"task {task.name}: a condition reads the old segment, so its DataFrame function must keep {OLD}")
    return out


def released(df: DataFrame, task: Task, window: JobWindow, trigger: Trigger) -> DataFrame:
    df, groups = grouped(df, task)
    if df.isStreaming:
        if trigger.on != "watermark":
            return processors.triggered(df, window, trigger, groups, task.seq)
        delay = f"{standard(trigger.delay)[0]} milliseconds" if trigger.delay else task.watermark_delay
        return processors.windowed(df, window, groups, delay)
    final = trigger.on in ("watermark", "timer")
    if trigger.refinement is not None or isinstance(trigger.on, CustomTrigger) or isinstance(window.aggregation, Aggregation) and not final:
        if task.seq is None:
            raise ValueError(f"task {task.name}: trigger {trigger.id} needs the order of arrival, in seq")
        return triggers.replay_fold(df, window, trigger, groups, task.seq, completion=True)
    if final:
        return triggers.final_state(df, window, groups, (task.seq,) if task.seq else ())
    if task.seq is None:
        raise ValueError(f"task {task.name}: trigger {trigger.id} needs the order of arrival, in seq")
    return triggers.replay(df, window, trigger, groups, task.seq, completion=trigger.on != "punctuation")


def plan(spark: SparkSession, job: Job, context: dict[str, dict] | None = None) -> Plan:
    """context: for each task, what its lifecycles have injected; its params replace the catalog's."""
    validate(job)
    made, context = Plan(), context or {}
    for name in job.order():
        task, egress = job.task(name), job.out_of(name)
        event = {"task": name} | context.get(name, {})
        df = resolve(task.source)(spark) if task.type == "input" else merge([made.edges[a, name] for a in job.into(name)])
        own = flow.relevant(job.flow_conditions, name, egress) if egress else []
        params = tuple(event.get("params", (*job.fn_params.get(name, ()), *task.params)))
        keep_old = any(getattr(c.predicate, "reads_old", False) for c in own)
        out = apply_fn(df, task, params, any(c.thrown_exception for c in own), keep_old)
        if task.type == "input" and task.assign_watermark_fn is not None:
            out = out.withColumn("watermark_ts", task.assign_watermark_fn(out)).withWatermark("watermark_ts", task.watermark_delay)
        emitted = []
        for w in (w for w in job.windows if w.task == name):
            for g in (g for g in job.triggers if g.window_id == w.id):
                made.fired[w.id, g.id] = got = released(out.where(F.col(ERROR).isNull()).drop(ERROR, OLD) if ERROR in out.columns else out.drop(OLD), task, w, g)
                if g.emit is not None:
                    emitted.append(resolve(g.emit)(got))
        if task.type == "reduce":
            out = merge(emitted) if emitted else out
        elif emitted:
            out = merge([out, *emitted])
        if not egress:
            made.outputs[name] = out
            continue
        for b, rows in flow.route(out, name, egress, job.flow_conditions, event).items():
            made.edges[name, b] = rows
    return made

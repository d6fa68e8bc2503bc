"""Flow conditions: which edges of a task a segment takes, as one boolean Column for each edge."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.model import FlowCondition
from millrace.operators.transform import ERROR, OLD


class Segment:
    """Access to a segment's fields by name: segment["age"]."""

    def __init__(self, at: str | None = None, names: Sequence[str] = ()):
        self._at, self.names = at, list(names)

    def __getitem__(self, key: str) -> Column:
        return F.col(f"`{self._at}`.`{key}`" if self._at else f"`{key}`")


def compile_predicate(p: Any, c: FlowCondition, event: dict, old: Segment, new: Segment, all_new: Any) -> Column:
    """One Column of a predicate; null counts as false, as nil does."""
    if callable(p):
        p = [p]
    head, *rest = p
    if head in ("and", "or", "not"):
        parts = [compile_predicate(x, c, event, old, new, all_new) for x in rest]
        if head == "not":
            return ~parts[0]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if head == "and" else out | x
        return out
    got = head(event, old, new, all_new, *(c.params[k] for k in rest))
    return F.coalesce(got if isinstance(got, Column) else F.lit(bool(got)), F.lit(False))


def relevant(conditions: Sequence[FlowCondition], task: str, egress: Sequence[str]) -> list[FlowCondition]:
    """A task's conditions: its own, and those from all tasks that lead to all or to edges that it has."""
    return [c for c in conditions if c.from_ == task or c.from_ == "all" and (isinstance(c.to, str) or set(c.to) <= set(egress))]


def _edges_of(to: Sequence[str] | str | None, egress: Sequence[str]) -> list[str]:
    """The edges that a condition's `to` names: 'all' is all of them, 'none' is none."""
    return list(egress) if to == "all" else [] if to is None or isinstance(to, str) else [e for e in egress if e in to]


def _fold(entries: Sequence[FlowCondition], hits: Sequence[Column], egress: Sequence[str], errors: Sequence[Column | None] = ()) -> tuple[dict[str, Column], dict[str, list[Column]], list[Column], list[tuple[FlowCondition, Column, dict[str, Column], dict[str, list[Column]]]]]:
    """(edge -> taken, key -> columns that exclude it, entry -> matched, failures). Entries count in order: a match adds its
    edges, 'none' takes all back, and a match that short-circuits ends the search. So does a predicate that raises
    (its error column is true): a failure is its entry, where it failed, and for each edge whether it goes there, that is to
    the edges taken so far and to predicate_errors_to, and the keys that are excluded by then."""
    live: Column = F.lit(True)
    taken: dict[str, Column] = {e: F.lit(False) for e in egress}
    excluded: dict[str, list[Column]] = {}
    matched, failures = [], []
    for c, hit, error in zip(entries, hits, errors or [None] * len(entries), strict=True):
        if error is not None:
            bad = live & error
            to = _edges_of(c.predicate_errors_to, egress)
            failures.append((c, bad, {e: F.lit(True) if e in to else taken[e] for e in egress}, {k: list(v) for k, v in excluded.items()}))
            live = live & ~error
        m = live & hit
        matched.append(m)
        back = c.to == "none" or c.action == "retry"
        to = [] if back else _edges_of(c.to, egress)
        for e in egress:
            taken[e] = taken[e] & ~m if back else taken[e] | m if e in to else taken[e]
        for k in c.exclude_keys:
            excluded.setdefault(k, []).append(m)
        if c.short_circuit:
            live = live & ~hit
    for _, bad, _, _ in failures:
        taken = {e: t & ~bad for e, t in taken.items()}
    return taken, excluded, matched, failures


def _send(df: DataFrame, edge: str, entries: Sequence[FlowCondition], taken: dict[str, Column], excluded: dict[str, list[Column]]) -> DataFrame:
    """Rows of one edge without the keys that their matched entries exclude: dropped where every entry that can
    lead here excludes them, else null in the rows that are without."""
    leads = [c for c in entries if c.to == "all" or not isinstance(c.to, str) and edge in c.to]
    out = df.where(taken[edge])
    for k in [k for k in excluded if k in df.columns]:
        if leads and all(k in c.exclude_keys for c in leads):
            continue
        hit = excluded[k][0]
        for h in excluded[k][1:]:
            hit = hit | h
        out = out.withColumn(k, F.when(~hit, F.col(k)))
    return out.drop(*(k for k in excluded if leads and all(k in c.exclude_keys for c in leads)))


def route(df: DataFrame, task: str, egress: Sequence[str], conditions: Sequence[FlowCondition], event: dict | None = None) -> dict[str, DataFrame]:
    """The DataFrame for each edge of a task. df: the task's output, with ERROR and OLD where it has them.

    Without any conditions in the job, every edge gets every segment. With conditions, a segment that matches none is
    dropped; a task that has only conditions on exceptions sends the rest to the edges that those don't name.
    Errors go by the conditions on exceptions alone; where there are none, they fail the job.
    A condition with predicate_errors_to has a Python predicate of dicts, which may raise: the segment then takes no more
    conditions and goes, made anew by post_transform from (event, rows with the structs old and new, error), to the edges
    that it has by then and to predicate_errors_to. Without a post_transform the error fails the job.
    """
    event, own = event or {}, relevant(conditions, task, egress)
    normal, thrown = [c for c in own if not c.thrown_exception], [c for c in own if c.thrown_exception]
    names = [c for c in df.columns if c not in (ERROR, OLD)]
    old, new = (Segment(OLD) if OLD in df.columns else Segment()), Segment(names=names)
    plain = df.where(F.col(ERROR).isNull()) if ERROR in df.columns else df
    if not conditions:
        out = {e: plain.select(*names) for e in egress}
    elif not normal:
        named = {e for c in thrown for e in (egress if c.to == "all" else () if c.to == "none" else c.to)}
        out = {e: plain.select(*names) if e not in named else plain.select(*names).where(F.lit(False)) for e in egress}
    else:
        guards = {i: c for i, c in enumerate(normal) if c.predicate_errors_to}
        for i, c in guards.items():
            plain = guard_predicate(plain, c, f"__guard{i}", names)
        hits = [F.col(f"__guard{i}.hit") if i in guards else compile_predicate(c.predicate, c, event, old, new, [new]) for i, c in enumerate(normal)]
        errors = [F.col(f"__guard{i}.error").isNotNull() if i in guards else None for i in range(len(normal))]
        taken, excluded, _, failures = _fold(normal, hits, egress, errors)
        out = {e: _send(plain, e, normal, taken, excluded).drop(ERROR, OLD, *(f"__guard{i}" for i in guards)) for e in egress}
        for i, (c, bad, goes, without) in zip(guards, failures, strict=True):
            for e in egress:
                rows = plain.where(bad & goes[e]).select((F.col(OLD) if OLD in plain.columns else F.struct(*names)).alias("old"), F.struct(*names).alias("new"), F.col(f"__guard{i}.error").alias(ERROR))
                rows = c.post_transform(event, rows, ERROR) if c.post_transform else rows.withColumn(ERROR, F.raise_error(F.col(f"{ERROR}.message")))
                out[e] = out[e].unionByName(rows.drop(*c.exclude_keys, *without), allowMissingColumns=True)
    if ERROR in df.columns and thrown:
        bad = df.where(F.col(ERROR).isNotNull())
        error = Segment(ERROR)
        hits = [compile_predicate(c.predicate, c, event, old, error, [error]) for c in thrown]
        taken, excluded, matched, _ = _fold(thrown, hits, egress)
        for e in egress:
            for c, m in zip(thrown, matched, strict=True):
                if c.to == "all" or not isinstance(c.to, str) and e in c.to:
                    rows = bad.where(m)
                    rows = c.post_transform(event, rows, ERROR) if c.post_transform else rows.drop(OLD)
                    rows = rows.drop(*c.exclude_keys).drop(OLD) if c.post_transform else rows.drop(*c.exclude_keys)
                    out[e] = out[e].unionByName(rows, allowMissingColumns=True) if out[e].columns != rows.columns else out[e].union(rows)
    return out


def guard_predicate(df: DataFrame, condition: FlowCondition, out: str, names: Sequence[str]) -> DataFrame:
    """df with the struct `out` of hit (boolean) and error (kind and message, null where there was none): what a Python
    predicate of dicts (event, old, new, all_new, *params) says of each row, in Arrow batches."""
    fn, *keys = condition.predicate if isinstance(condition.predicate, list | tuple) else [condition.predicate]
    if not callable(fn):
        raise ValueError("a condition with predicate_errors_to has one Python predicate, not a combination")
    params = [condition.params[k] for k in keys]
    plain = lambda row: row.asDict(True) if hasattr(row, "asDict") else dict(row)

    @F.udf("struct<hit:boolean,error:struct<type:string,message:string>>", useArrow=True)
    def call(o, n):
        try:
            new = plain(n)
            return bool(fn({}, plain(o), new, [new], *params)), None
        except Exception as e:
            return False, (type(e).__name__, str(e))

    return df.withColumn(out, call(F.col(OLD) if OLD in df.columns else F.struct(*names), F.struct(*names)))

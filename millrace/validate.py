"""What a job must hold to before it is planned. All problems are told at once."""

from __future__ import annotations

from collections import Counter

from millrace.model import Job
from millrace.operators.aggregations import AGGREGATIONS, Aggregation
from millrace.units import standard


class InvalidJob(ValueError):
    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


def _twice(names) -> list[str]:
    return [n for n, k in Counter(names).items() if k > 1]


def _units(amount) -> str | None:
    try:
        return standard(amount)[1]
    except (ValueError, TypeError):
        return None


def _tasks(job: Job):
    names = [t.name for t in job.catalog]
    for n in _twice(names):
        yield f"task {n} is in the catalog twice"
    for t in job.catalog:
        if t.type not in ("input", "function", "output", "reduce"):
            yield f"task {t.name}: unknown type {t.type}"
        if t.type == "function" and t.fn is None:
            yield f"function task {t.name} has no fn"
        if t.type == "input" and t.source is None:
            yield f"input task {t.name} has no source"
        if t.batch_size < 1:
            yield f"task {t.name}: batch_size must be positive"
        if t.batch_fn and (t.fn is None or t.schema is None):
            yield f"task {t.name}: a batch fn needs fn and schema"
        if t.group_by_key is not None and t.group_by_fn is not None:
            yield f"task {t.name}: group_by_key and group_by_fn exclude each other"
        if (t.group_by_key is not None or t.group_by_fn is not None) and t.flux_policy not in ("continue", "kill", "recover"):
            yield f"grouped task {t.name} needs a flux_policy: continue, kill or recover"
        if t.flux_policy == "recover" and not (t.n_peers or t.min_peers and t.min_peers == t.max_peers):
            yield f"task {t.name}: flux_policy recover needs n_peers, or min_peers equal to max_peers"
        if t.assign_watermark_fn is not None and t.type != "input":
            yield f"task {t.name}: only inputs assign watermarks"
        if t.min_peers and t.max_peers and t.min_peers > t.max_peers:
            yield f"task {t.name}: min_peers exceeds max_peers"
        if t.n_peers and (t.min_peers or t.max_peers) and not t.n_peers == t.max_peers == 1:
            yield f"task {t.name}: n_peers excludes min_peers and max_peers"


def _workflow(job: Job):
    names = {t.name for t in job.catalog}
    for a, b in _twice(map(tuple, job.workflow)):
        yield f"edge {a} -> {b} is there twice"
    for n in sorted({x for e in job.workflow for x in e} - names):
        yield f"the workflow names {n}, which is not in the catalog"
    for n in sorted(names - {x for e in job.workflow for x in e}):
        yield f"task {n} is not in the workflow"
    windowed = {w.task for w in job.windows}
    for t in job.catalog:
        if t.type == "input" and job.into(t.name):
            yield f"input task {t.name} has an incoming edge"
        if t.type == "function" and not (job.into(t.name) and job.out_of(t.name)):
            yield f"function task {t.name} needs incoming and outgoing edges"
        if t.type == "output" and job.out_of(t.name):
            yield f"output task {t.name} has an outgoing edge"
        if t.type == "reduce" and job.out_of(t.name):
            ids = {w.id for w in job.windows if w.task == t.name}
            if t.name not in windowed or not any(g.emit for g in job.triggers if g.window_id in ids):
                yield f"reduce task {t.name} feeds others, so it needs a window and a trigger that emits"
    if names >= {x for e in job.workflow for x in e}:
        try:
            job.order()
        except ValueError as e:
            yield str(e)


def _predicate(p) -> str | None:
    if callable(p):
        return None
    if not isinstance(p, list | tuple) or not p:
        return "a predicate is a function or a list"
    head, *rest = p
    if head in ("and", "or"):
        return f"'{head}' needs two predicates at least" if len(rest) < 2 else next(filter(None, map(_predicate, rest)), None)
    if head == "not":
        return "'not' takes one predicate" if len(rest) != 1 else _predicate(rest[0])
    return None if callable(head) else f"unknown predicate {head!r}"


def _conditions(job: Job):
    by_task: dict[tuple[str, bool], list] = {}
    for c in job.flow_conditions:
        names = {t.name for t in job.catalog}
        if c.from_ != "all" and c.from_ not in names:
            yield f"a condition is from {c.from_}, which is not a task"
        elif c.from_ != "all" and not isinstance(c.to, str):
            for b in [*c.to, *(() if isinstance(c.predicate_errors_to, str) else c.predicate_errors_to or ())]:
                if b not in job.out_of(c.from_):
                    yield f"a condition sends from {c.from_} to {b}, which is no edge"
        if isinstance(c.to, str) and c.to not in ("all", "none"):
            yield f"condition to {c.to!r}: a list of tasks, 'all' or 'none'"
        if problem := _predicate(c.predicate):
            yield problem
        if c.to in ("all", "none") and not c.short_circuit:
            yield f"a condition to {c.to} must short-circuit"
        if c.thrown_exception and not c.short_circuit:
            yield "a condition on exceptions must short-circuit"
        if c.action == "retry" and c.to != "none":
            yield "a retry goes to none"
        by_task.setdefault((c.from_, c.thrown_exception), []).append(c)
    for (task, _), group in by_task.items():
        kinds = [0 if c.to == "all" else 1 if c.to == "none" else 2 for c in group]
        if kinds != sorted(kinds):
            yield f"conditions from {task}: 'all' comes first, then 'none'"
        if any(not a.short_circuit and b.short_circuit for a, b in zip(group, group[1:], strict=False)):
            yield f"conditions from {task}: those that short-circuit come first"


def _windows(job: Job):
    for i in _twice(w.id for w in job.windows):
        yield f"window id {i} is there twice"
    for w in job.windows:
        at = f"window {w.id}"
        if w.task not in {t.name for t in job.catalog}:
            yield f"{at} is on {w.task}, which is not a task"
        name = w.aggregation if isinstance(w.aggregation, str | Aggregation) else w.aggregation[0]
        if not isinstance(name, Aggregation):
            if name not in AGGREGATIONS:
                yield f"{at}: unknown aggregation {name}"
            if name in ("min", "max") and w.init is None:
                yield f"{at}: {name} needs an init"
            if name not in ("conj", "count") and isinstance(w.aggregation, str):
                yield f"{at}: {name} needs a key"
        elif name.init is None and w.init is None:
            yield f"{at}: its aggregation has no init, so the window needs one"
        units = {n: _units(v) for n, v in (("range", w.range), ("slide", w.slide), ("timeout_gap", w.timeout_gap)) if v is not None}
        for n in (n for n, u in units.items() if u is None):
            yield f"{at}: {n} has no known unit"
        need = {"fixed": ({"range"}, {"slide", "timeout_gap"}), "sliding": ({"range", "slide"}, {"timeout_gap"}), "global": (set(), {"range", "slide", "timeout_gap"}), "session": ({"timeout_gap"}, {"range", "slide"})}.get(w.type)
        if need is None:
            yield f"{at}: unknown type {w.type}"
            continue
        for n in sorted(need[0] - set(units)):
            yield f"{at}: a {w.type} window needs {n}"
        for n in sorted(need[1] & set(units)):
            yield f"{at}: a {w.type} window takes no {n}"
        if w.type != "global" and w.window_key is None:
            yield f"{at}: a {w.type} window needs a window_key"
        if len(set(units.values()) - {None}) > 1:
            yield f"{at}: range and slide differ in kind"
        kinds = set(w.storage_strategy)
        if kinds - {"incremental", "ordered-log", "extents"}:
            yield f"{at}: unknown storage strategy"
        if "ordered-log" in kinds and w.type in ("sliding", "session"):
            yield f"{at}: no ordered log for {w.type} windows"
        if {"extents", "incremental"} <= kinds:
            yield f"{at}: extents excludes incremental"
        if w.type == "session" and not kinds & {"incremental", "extents"}:
            yield f"{at}: a session window stores incremental or extents"


def _triggers(job: Job):
    for i in _twice((g.window_id, g.id) for g in job.triggers):
        yield f"trigger {i[1]} of window {i[0]} is there twice"
    for g in job.triggers:
        at = f"trigger {g.id}"
        if g.window_id not in {w.id for w in job.windows}:
            yield f"{at} names window {g.window_id}, which is not there"
        if g.on == "segment" and (g.threshold is None or _units(g.threshold) != "elements"):
            yield f"{at}: a segment trigger needs a threshold in elements"
        if g.on == "timer" and (g.period is None or _units(g.period) != "ms"):
            yield f"{at}: a timer trigger needs a period of time"
        if g.on == "punctuation" and g.pred is None:
            yield f"{at}: a punctuation trigger needs a pred"
        if g.on == "percentile-watermark" and g.watermark_percentage is None:
            yield f"{at}: a percentile trigger needs a watermark_percentage"
        if g.on in ("watermark", "percentile-watermark") and "window-state" not in g.state_context:
            yield f"{at}: {g.on} needs the state context window-state"
        if isinstance(g.on, str) and g.on not in ("segment", "timer", "punctuation", "watermark", "percentile-watermark"):
            yield f"{at}: unknown kind {g.on}"
        if g.post_evictor not in ("all", "none"):
            yield f"{at}: post_evictor is all or none"
        if g.emit is None and g.sync is None:
            yield f"{at} neither emits nor syncs"


def _rest(job: Job):
    names = {t.name for t in job.catalog}
    for x in job.lifecycles:
        if x.task != "all" and x.task not in names:
            yield f"a lifecycle is for {x.task}, which is not a task"
        for c in set(x.calls) - {"start_task", "before_task_start", "before_batch", "after_read_batch", "after_apply_fn", "after_batch", "after_task_stop", "handle_exception"}:
            yield f"unknown lifecycle call {c}"
    if job.task_scheduler not in ("balanced", "percentage", "colocated"):
        yield f"unknown task scheduler {job.task_scheduler}"
    if job.resume_point is not None:
        need = {t.name for t in job.catalog if t.type == "input"} | {w.id for w in job.windows}
        for n in sorted(need - set(job.resume_point)):
            yield f"the resume point leaves out {n}"
        for n, how in job.resume_point.items():
            if how.get("mode") not in ("resume", "initialize"):
                yield f"resume point of {n}: mode is resume or initialize"
            elif how["mode"] == "resume" and not how.get("job-id"):
                yield f"resume point of {n} needs the job-id that it resumes"
        if len({(how.get("mode"), how.get("job-id") if how.get("mode") == "resume" else None) for how in job.resume_point.values()}) > 1:
            yield "a resume point takes inputs and windows from one job, or initializes all: a stream's offsets and state are kept together"


def validate(job: Job) -> Job:
    problems = [p for check in (_tasks, _workflow, _conditions, _windows, _triggers, _rest) for p in check(job)]
    if problems:
        raise InvalidJob(problems)
    return job

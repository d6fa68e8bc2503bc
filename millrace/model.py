"""A job as data: tasks, edges, flow conditions, windows, triggers and lifecycles.

Names follow the usual vocabulary of dataflow jobs: segments (rows) travel along the edges of a
workflow; each task applies a function to them; conditions decide which edges a segment takes; windows
gather segments in extents, and triggers decide when an extent's state is released.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass
class Task:
    """fn: a function (*params, DataFrame) -> DataFrame; with `schema` (a DDL string) a Python function
    (*params, dict) -> dict or list of dicts, or with batch_fn (*params, list of dicts) -> list of as many."""

    name: str
    type: str  # input, function, output, reduce
    fn: Callable | None = None
    params: Sequence[Any] = ()
    schema: str | None = None
    batch_fn: bool = False
    batch_size: int = 1000
    source: Any = None
    sink: Any = None
    seq: str | None = None
    group_by_key: str | Sequence[str] | None = None
    group_by_fn: Callable | None = None
    flux_policy: str | None = None
    assign_watermark_fn: Callable | None = None
    watermark_delay: str = "0 seconds"
    min_peers: int | None = None
    max_peers: int | None = None
    n_peers: int | None = None
    doc: str = ""


@dataclass
class FlowCondition:
    """predicate: f(event, old, new, all_new, *params) -> Column, [f, "key", ...] with values looked up in params, or
    ["and" | "or" | "not", ...] of such. to: task names, "all" or "none"."""

    from_: str
    to: Sequence[str] | str
    predicate: Any
    params: dict = field(default_factory=dict)
    short_circuit: bool = False
    exclude_keys: Sequence[str] = ()
    thrown_exception: bool = False
    post_transform: Callable | None = None
    predicate_errors_to: Sequence[str] | None = None
    action: str | None = None
    doc: str = ""


@dataclass
class Window:
    id: str
    task: str
    type: str  # fixed, sliding, global, session
    aggregation: Any  # name, [name, key] or Aggregation
    window_key: str | None = None
    range: tuple | None = None
    slide: tuple | None = None
    timeout_gap: tuple | None = None
    min_value: int = 0
    init: Any = None
    storage_strategy: Sequence[str] = ("incremental",)
    doc: str = ""


@dataclass
class Trigger:
    id: str
    window_id: str
    on: Any  # segment, timer, punctuation, watermark, percentile-watermark, or a custom trigger
    threshold: tuple | None = None
    period: tuple | None = None
    pred: Callable | None = None
    delay: tuple | None = None
    watermark_percentage: float | None = None
    fire_all_extents: bool = False
    post_evictor: str = "none"  # none, all
    refinement: Callable | None = None
    state_context: Sequence[str] = ("trigger-state",)
    emit: Callable | None = None
    sync: Callable | None = None
    doc: str = ""


@dataclass
class Lifecycle:
    """Hooks by name: start_task (True to go on), before_task_start, before_batch, after_read_batch, after_apply_fn,
    after_batch, after_task_stop, handle_exception ("restart", "kill" or "defer"). task: a name or "all"."""

    task: str
    calls: dict[str, Callable]
    doc: str = ""


@dataclass
class Job:
    workflow: Sequence[tuple[str, str]]
    catalog: Sequence[Task]
    flow_conditions: Sequence[FlowCondition] = ()
    windows: Sequence[Window] = ()
    triggers: Sequence[Trigger] = ()
    lifecycles: Sequence[Lifecycle] = ()
    metadata: dict = field(default_factory=dict)
    resume_point: dict | None = None
    fn_params: dict[str, Sequence[Any]] = field(default_factory=dict)
    task_scheduler: str = "balanced"
    percentage: int | None = None

    def task(self, name: str) -> Task:
        return next(t for t in self.catalog if t.name == name)

    def into(self, name: str) -> list[str]:
        return [a for a, b in self.workflow if b == name]

    def out_of(self, name: str) -> list[str]:
        return [b for a, b in self.workflow if a == name]

    def order(self) -> list[str]:
        """Task names, each after those that feed it."""
        left = {t.name: set(self.into(t.name)) for t in self.catalog}
        out: list[str] = []
        while left:
            ready = [n for n, need in left.items() if need <= set(out)]
            if not ready:
                raise ValueError(f"the workflow has a cycle among {sorted(left)}")
            out += ready
            for n in ready:
                del left[n]
        return out

    def add_task(self, task: Task, *behaviours: Callable[[Task], Task], lifecycles: Sequence[Lifecycle] = ()) -> Job:
        """The job with one more task, changed by each behaviour in turn, and its lifecycles."""
        for change in behaviours:
            task = change(task)
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return Job(**own | {"catalog": [*self.catalog, task], "lifecycles": [*self.lifecycles, *lifecycles]})


def edges(graph: dict[str, Sequence[str] | set[str]]) -> list[tuple[str, str]]:
    """Edges of a map from task to the tasks that it feeds."""
    return [(a, b) for a, to in graph.items() for b in sorted(to)]


JOBS: dict[str, Callable[..., Job]] = {}


def register_job(name: str):
    """Names a function that builds a job, for build_job()."""

    def keep(make: Callable[..., Job]) -> Callable[..., Job]:
        JOBS[name] = make
        return make

    return keep


def build_job(name: str, *args, **kwargs) -> Job:
    return JOBS[name](*args, **kwargs)

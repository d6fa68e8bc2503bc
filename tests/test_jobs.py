"""Jobs: validation, routing, the engine's control calls, and the fold that streams use against batch replay."""

import pytest
from pyspark.sql import functions as F

from millrace import sources
from millrace.engine import Engine, job_hash
from millrace.model import FlowCondition, Job, Lifecycle, Task, Trigger, Window
from millrace.operators.triggers import replay
from millrace.plans.planner import plan
from millrace.streaming.fold import Fold
from millrace.validate import InvalidJob, validate


GOT: list[int] = []
CALLS: list[str] = []


def numbers(n, **more):
    catalog = [Task("in", "input", source=sources.seq([(i,) for i in range(n)], "n long")), Task("add", "function", fn=lambda df: df.withColumn("n", F.col("n") + 1)), Task("out", "output", **more)]
    return [("in", "add"), ("add", "out")], catalog


def test_engine_runs_awaits_and_refuses(spark):
    edges, catalog = numbers(5, sink=lambda df: GOT.extend(r.n for r in df.collect()))
    hooks = {c: (lambda context, c=c: CALLS.append(c) or {}) for c in ("before_task_start", "before_batch", "after_batch")} | {"after_task_stop": lambda context: CALLS.append("after_task_stop")}
    job = Job(edges, catalog, lifecycles=[Lifecycle("out", hooks)], metadata={"job-id": "one"})
    engine = Engine(spark)
    assert engine.submit(job) == {"success": True, "job_id": "one"} and engine.await_job("one", 60) is True
    assert sorted(GOT) == [1, 2, 3, 4, 5] and CALLS == ["before_task_start", "before_batch", "after_batch", "after_task_stop"]
    assert engine.submit(job)["success"] and sorted(GOT) == [1, 2, 3, 4, 5]
    other = Job(edges, [catalog[0], Task("add", "function", fn=lambda df: df.withColumn("n", F.col("n") + 2)), catalog[2]], lifecycles=job.lifecycles, metadata={"job-id": "one"})
    assert engine.submit(other) == {"success": False, "job_id": "one", "error": "incorrect-job-hash"}
    assert engine.state("one") == "completed" and engine.history() == ["one"] and not engine.kill("one") and engine.gc() == 1


def test_engine_refuses_invalid_jobs_with_lifecycles(spark):
    edges, catalog = numbers(3)
    job = Job([*edges, ("add", "nowhere")], catalog, lifecycles=[Lifecycle("out", {})])
    got = Engine(spark).submit(job)
    assert not got["success"] and any("nowhere" in p for p in got["problems"])


def test_engine_kills_on_errors_and_restarts(spark):
    tries = []

    def sink(df):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")

    edges, catalog = numbers(2, sink=sink)
    engine = Engine(spark)
    one = engine.submit(Job(edges, catalog))["job_id"]
    assert engine.await_job(one, 60) is False and isinstance(engine.runs[one].error, RuntimeError)
    again = Lifecycle("all", {"handle_exception": lambda *a: "restart"})
    two = engine.submit(Job(edges, catalog, lifecycles=[again]))["job_id"]
    assert engine.await_job(two, 60) is True and len(tries) == 3


def test_job_hash_tells_functions_apart():
    make = lambda k: Job(*numbers(3)[:1], [Task("t", "function", fn=lambda df: df.where(F.col("n") > k))])
    assert job_hash(make(1)) == job_hash(make(1)) != job_hash(make(2))
    a, b = (Job([], [Task("t", "function", fn=f)]) for f in (lambda df: df.limit(1), lambda df: df.limit(2)))
    assert job_hash(a) != job_hash(b)


@pytest.mark.parametrize("change, told", [
    (lambda e, c: Job(e, [*c, Task("extra", "output")]), "extra is not in the workflow"),
    (lambda e, c: Job([*e, ("out", "add")], c), "outgoing"),
    (lambda e, c: Job(e, c, [FlowCondition("add", ["elsewhere"], lambda *a: F.lit(True))]), "no edge"),
    (lambda e, c: Job(e, c, [FlowCondition("add", "all", lambda *a: F.lit(True))]), "short-circuit"),
    (lambda e, c: Job(e, c, windows=[Window("w", "add", "fixed", "count", window_key="n")]), "needs range"),
    (lambda e, c: Job(e, c, windows=[Window("w", "add", "global", "count")], triggers=[Trigger("g", "w", "segment", emit=lambda d: d)]), "threshold"),
    (lambda e, c: Job(e, c, resume_point={"in": {"mode": "other"}}), "resume or initialize"),
])
def test_validation_tells(change, told):
    with pytest.raises(InvalidJob, match=told):
        validate(change(*numbers(3)))


def test_conditions_beside_one_that_raises(spark):
    edges, catalog = numbers(9)
    catalog = [*catalog[:2], *(Task(o, "output") for o in ("a", "b", "err"))]

    def picky(event, old, new, all_new):
        if new["n"] == 4:
            raise ValueError("four")
        return new["n"] % 2 == 0

    fix = lambda event, rows, error: rows.select(F.col("new.n").alias("n"), F.col(f"{error}.message").alias("why"))
    conditions = [FlowCondition("add", ["b"], lambda *a: F.lit(True)), FlowCondition("add", ["a"], picky, predicate_errors_to=["err"], post_transform=fix)]
    out = plan(spark, Job([("in", "add"), *(("add", o) for o in ("a", "b", "err"))], catalog, conditions)).outputs
    rows = {e: sorted((r.n, r["why"] if "why" in r else None) for r in df.collect()) for e, df in out.items()}
    assert rows == {"a": [(n, None) for n in (2, 6, 8)], "b": [(n, "four" if n == 4 else None) for n in range(1, 10)], "err": [(4, "four")]}


def test_refinement_is_no_window_function(spark):
    df = spark.createDataFrame([(1, 1)], "seq long, n long")
    with pytest.raises(ValueError, match="refinement"):
        replay(df, Window("w", "t", "global", "count"), Trigger("g", "w", "segment", threshold=(1, "elements"), refinement=lambda s: s))


@pytest.mark.parametrize("evictor", ["none", "all"])
@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("window", [Window("w", "t", "global", "count"), Window("w", "t", "fixed", ("sum", "v"), window_key="n", range=(10, "elements")), Window("w", "t", "sliding", "count", window_key="n", range=(10, "elements"), slide=(5, "elements"))], ids=["global", "fixed", "sliding"])
def test_replay_equals_the_fold_of_streams(spark, window, every, evictor):
    trigger = Trigger("g", "w", "segment", threshold=(3, "elements"), fire_all_extents=every, post_evictor=evictor, emit=lambda df: df)
    rows = [(i, (i * 7) % 40, i % 5) for i in range(25)]
    got = {(r.seq_, r.lower_ms, r.upper_ms, r.state) for r in replay(spark.createDataFrame(rows, "seq long, n long, v long"), window, trigger, [], "seq").select(F.col("fire_seq").alias("seq_"), "lower_ms", "upper_ms", "state").collect()}
    want = {(i, *e, s) for i, e, s in Fold(window, trigger).run([({"seq": s, "n": n, "v": v}, n) for s, n, v in rows])}
    assert got == want

"""Runs jobs: submit, await, kill, and what is known about them."""

from __future__ import annotations

import hashlib
import pickle
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import shared
from millrace.model import Job
from millrace.plans.planner import Plan, plan
from millrace.streaming.processors import ROCKS, STORE, unpacked
from millrace.validate import InvalidJob, validate


@dataclass
class Run:
    id: str
    job: Job
    hash: str
    state: str = "running"  # running, completed, killed
    error: BaseException | None = None
    plan: Plan | None = None
    thread: threading.Thread | None = None
    queries: list = field(default_factory=list)


def job_hash(job: Job) -> str:
    """The same for jobs with the same content. Functions count by their names, code, defaults and what they close over."""

    def code(c: Any) -> Any:
        return [c.co_code.hex(), list(c.co_names), [code(k) if hasattr(k, "co_code") else repr(k) for k in c.co_consts]]

    def function(f: Any) -> Any:
        held = [plain(c.cell_contents) for c in f.__closure__ or ()]
        return [f.__qualname__, code(f.__code__), plain(list(f.__defaults__ or ())), held]

    def plain(x: Any) -> Any:
        if hasattr(x, "__code__"):
            return function(x)
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in sorted(x.items(), key=lambda i: str(i[0]))}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        if hasattr(x, "__dataclass_fields__"):
            return {k: plain(getattr(x, k)) for k in x.__dataclass_fields__}
        if isinstance(x, DataFrame):
            return x._jdf.queryExecution().analyzed().canonicalized().toString()
        return getattr(x, "__qualname__", None) or repr(x) if callable(x) else x

    return hashlib.sha256(pickle.dumps(plain(job), protocol=4)).hexdigest()


class Engine:
    """Jobs of one session. Batch jobs run in a thread and a Spark job group of their own; streaming outputs are
    queries with a checkpoint folder of their own, so a job that is submitted again with it resumes."""

    def __init__(self, spark: SparkSession, checkpoints: str | None = None):
        self.spark, self.checkpoints, self.runs = spark, checkpoints, {}
        self.log: list[dict] = []
        self.subscribers: list[Callable[[dict], None]] = []

    # -- log

    def _tell(self, entry: str, job_id: str, **more: Any) -> None:
        self.log.append({"id": len(self.log), "entry": entry, "job_id": job_id} | more)
        for call in self.subscribers:
            call(self.log[-1])

    def subscribe(self, call: Callable[[dict], None]) -> None:
        """call for each entry of the engine's log, those so far first."""
        for entry in self.log:
            call(entry)
        self.subscribers.append(call)

    # -- submission

    def submit(self, job: Job, sinks_mode: str = "append", trigger: dict | None = None) -> dict:
        """{"success": True, "job_id": id}, or the problems. A job id that has been seen is accepted again, and
        not run again, if the job is the same; else it is refused."""
        id_, hash_ = str(job.metadata.get("job-id") or uuid.uuid4()), job_hash(job)
        if id_ in self.runs:
            same = self.runs[id_].hash == hash_
            return {"success": same, "job_id": id_} | ({} if same else {"error": "incorrect-job-hash"})
        run = Run(id_, job, hash_)
        try:
            validate(job)
            context = {t.name: {} for t in job.catalog}
            run.plan = plan(self.spark, job, context) if not job.lifecycles else None
        except InvalidJob as e:
            return {"success": False, "problems": e.problems}
        self.runs[id_] = run
        self._tell("submit-job", id_)
        run.thread = InheritableThread(target=self._run, args=(run, sinks_mode, trigger or {"availableNow": True}), daemon=True)
        run.thread.start()
        return {"success": True, "job_id": id_}

    def _calls(self, job: Job, name: str, call: str) -> list[Callable]:
        return [x.calls[call] for x in job.lifecycles if x.task in ("all", name) and call in x.calls]

    def _run(self, run: Run, mode: str, trigger: dict) -> None:
        self.spark.sparkContext.setJobGroup(run.id, f"job {run.id}", interruptOnCancel=True)
        while run.state == "running":
            context: dict[str, dict] = {t.name: {"task": t.name, "job_id": run.id} for t in run.job.catalog}
            try:
                self._attempt(run, context, mode, trigger)
                if run.state == "running":
                    run.state = "completed"
                    self._tell("job-completed", run.id)
            except BaseException as e:
                run.error = e
                handlers = [h for t in run.job.catalog for h in self._calls(run.job, t.name, "handle_exception")]
                # The first that doesn't defer decides; without one the job is killed.
                verdict = next((v for h in handlers if (v := h(context, None, "task", e)) != "defer"), "kill")
                if verdict == "restart" and run.state == "running":
                    self._tell("restart-job", run.id, error=str(e))
                elif run.state == "running":
                    run.state = "killed"
                    self._tell("kill-job", run.id, error=str(e))
            finally:
                for t in run.job.catalog:
                    for call in self._calls(run.job, t.name, "after_task_stop"):
                        call(context[t.name])

    def _attempt(self, run: Run, context: dict[str, dict], mode: str, trigger: dict) -> None:
        for t in run.job.catalog:
            while run.state == "running" and not all(call(context[t.name]) for call in self._calls(run.job, t.name, "start_task")):
                time.sleep(0.05)
            for call in self._calls(run.job, t.name, "before_task_start"):
                context[t.name] |= call(context[t.name]) or {}
        run.plan = run.plan or plan(self.spark, run.job, context)
        for g in run.job.triggers:
            if g.sync is not None and not run.plan.fired[g.window_id, g.id].isStreaming:
                g.sync(run.plan.fired[g.window_id, g.id])
        for name, df in run.plan.outputs.items():
            if run.state != "running":
                return
            task = run.job.task(name)
            sink = task.sink or (lambda d: d.write.format("noop").mode("append").save())
            hooks = {c: self._calls(run.job, name, c) for c in ("before_batch", "after_read_batch", "after_apply_fn", "after_batch")}

            def one(batch: DataFrame, epoch: int = 0, sink=sink, hooks=hooks, own=context[name]) -> None:
                for c in ("before_batch", "after_read_batch", "after_apply_fn"):
                    for call in hooks[c]:
                        own |= call(own | {"batch": batch, "epoch": epoch}) or {}
                sink(batch)
                for call in hooks["after_batch"]:
                    own |= call(own | {"batch": batch, "epoch": epoch}) or {}

            if df.isStreaming:
                writer = df.writeStream.foreachBatch(one).trigger(**trigger).outputMode(mode)
                if self.checkpoints:
                    writer = writer.option("checkpointLocation", self._resumed(run, name))
                before = self.spark.conf.get(STORE)
                self.spark.conf.set(STORE, ROCKS)
                try:
                    run.queries.append(writer.start())
                finally:
                    self.spark.conf.set(STORE, before)
            else:
                one(df)
        for q in run.queries:
            q.awaitTermination()

    def _resumed(self, run: Run, name: str) -> str:
        """The checkpoint folder of an output's stream. A job with a resume point begins with a copy of the offsets and state
        of the same output of the job that it names."""
        own = f"{self.checkpoints}/{run.id}/{name}"
        from_ = {how.get("job-id") for how in (run.job.resume_point or {}).values() if how["mode"] == "resume"}
        if from_ and not shared.exists(self.spark, own):
            shared.copy(self.spark, f"{self.checkpoints}/{from_.pop()}/{name}", own)
            self._tell("resume-job", run.id, task=name)
        return own

    # -- control

    def await_job(self, job_id: str, timeout: float | None = None) -> bool | str:
        """True if the job completed, False if it was killed, "timeout" if it is still running then."""
        run = self.runs[job_id]
        run.thread.join(timeout)
        return "timeout" if run.thread.is_alive() else run.state == "completed"

    def kill(self, job_id: str) -> bool:
        run = self.runs.get(job_id)
        if run is None or run.state != "running":
            return False
        run.state = "killed"
        self._tell("kill-job", job_id)
        self.spark.sparkContext.cancelJobGroup(job_id)
        for q in run.queries:
            q.stop()
        return True

    def state(self, job_id: str) -> str | None:
        run = self.runs.get(job_id)
        return run and run.state

    def metadata(self, job_id: str) -> dict:
        return self.runs[job_id].job.metadata

    def history(self) -> list[str]:
        return list(self.runs)

    def snapshot(self, job_id: str) -> dict:
        """Where a job's streams have come to: the coordinates that a resume point names."""
        return {q.id: {"batch": (q.lastProgress or {}).get("batchId"), "checkpoint": f"{self.checkpoints}/{job_id}"} for q in self.runs[job_id].queries}

    def named_snapshot(self, name: str) -> tuple[str, dict] | None:
        """The latest job whose metadata has this job-name, and its snapshot."""
        named = [i for i, r in self.runs.items() if r.job.metadata.get("job-name") == name]
        return (named[-1], self.snapshot(named[-1])) if named else None

    def resume_point(self, job_id: str) -> dict:
        """What a job like this one takes as its resume_point to go on where it has come to."""
        job = self.runs[job_id].job
        names = [*(t.name for t in job.catalog if t.type == "input"), *(w.id for w in job.windows)]
        return {n: {"mode": "resume", "job-id": job_id} for n in names}

    def window_state(self, job_id: str, output: str) -> DataFrame:
        """The extents that a job's stream to an output holds, from its last committed batch: group (a struct), lower_ms, upper_ms
        (null for the global extent) and state (JSON)."""
        got = self.spark.read.format("statestore").option("stateVarName", "extents").load(f"{self.checkpoints}/{job_id}/{output}")
        lower, upper = F.col("user_map_key.lower"), F.col("user_map_key.upper")
        open_ = (lower == 0) & (upper == -1)
        state = unpacked("user_map_value.state").alias("state")
        return got.select(F.col("key").alias("group"), F.when(~open_, lower).alias("lower_ms"), F.when(~open_, upper).alias("upper_ms"), state)

    def gc(self) -> int:
        """Forgets jobs that have ended; returns how many."""
        done = [i for i, r in self.runs.items() if r.state != "running"]
        for i in done:
            del self.runs[i]
        return len(done)

    def clear_checkpoints(self, job_id: str) -> None:
        """Deletes the checkpoint folders of a job, through Spark's file systems."""
        if self.checkpoints:
            shared.delete(self.spark, f"{self.checkpoints}/{job_id}")

"""Queries of whole jobs: run by the engine from source to sink, or planned with parts that single operators don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace import shared, sources, tasks
from millrace.engine import Engine
from millrace.model import FlowCondition, Job, Lifecycle, Task, Trigger, Window
from millrace.operators import batch, patterns
from millrace.operators.windows import aggregate
from millrace.plans.planner import plan
from millrace.queries import DAY, _edge_sql, _edges, _events, _fixed_sql, _orders, _read, _stream, _through, always, oracle_sql, queries, query
from millrace.streaming.fold import CustomTrigger
from millrace.streaming.processors import drain, windowed

__all__ = ["oracle_sql", "queries"]


def _finish(engine: Engine, job: Job) -> str:
    """Runs a job to its end; its error is raised."""
    got = engine.submit(job)
    if not got["success"]:
        raise ValueError(got)
    if not engine.await_job(got["job_id"]):
        raise engine.runs[got["job_id"]].error
    return got["job_id"]


def _out(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


# -- sources, sinks and lifecycles


@query("SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents")
def job_text_file(spark, sf):
    """A text file's lines, from the file input to a channel output."""
    root = shared.folder(spark, "text_file")
    _read("documents")(spark, sf).select("text").write.option("lineSep", "\n").text(f"{root}/in")
    _finish(Engine(spark), Job([("in", "out")], [tasks.text("in", f"{root}/in"), tasks.channel_out("out", f"{root}/out")]))
    return _out(spark, f"{root}/out", "line string")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'literal'), (2, 'literal'), (10, 'made'), (20, 'made')) AS t(n, kind)")
def job_literal_inputs(spark, sf):
    root = shared.folder(spark, "literal")
    catalog = [tasks.literal("a", [(1, "literal"), (2, "literal")], "n long, kind string"), tasks.made("b", lambda: [(10 * i, "made") for i in (1, 2)], "n long, kind string"), tasks.channel_out("out", root)]
    _finish(Engine(spark), Job([("a", "out"), ("b", "out")], catalog))
    return _out(spark, root, "n long, kind string")


class _Range(InputPartition):
    def __init__(self, lower: int, upper: int):
        self.lower, self.upper = lower, upper


class _Numbers(DataSource):
    """A user's input plugin: the numbers below `upto`, in four partitions."""

    @classmethod
    def name(cls) -> str:
        return "numbers"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema) -> DataSourceReader:
        return _NumbersReader(int(self.options["upto"]))


class _NumbersReader(DataSourceReader):
    def __init__(self, upto: int):
        self.upto = upto

    def partitions(self) -> list[InputPartition]:
        return [_Range(self.upto * i // 4, self.upto * (i + 1) // 4) for i in range(4)]

    def read(self, partition: _Range):
        yield from ((n,) for n in range(partition.lower, partition.upper))


@query("SELECT n, n * n AS square FROM (SELECT unnest(range(1000)) AS n)")
def job_plugin_input(spark, sf):
    square = lambda df: df.withColumn("square", F.col("n") * F.col("n"))
    return _through(spark, sources.plugin(_Numbers, upto=1000)(spark), tasks.function("square", square))["out"]


@query("SELECT o_orderkey, (o_totalprice + 10) * 3 AS price FROM orders")
def job_injected_params(spark, sf):
    """Parameters of one function from a lifecycle, of another from the job; functions on an input and an output, too."""
    root = shared.folder(spark, "params")
    catalog = [
        Task("in", "input", source=sources.frame(_orders(spark, sf)), fn=lambda df: df.select("o_orderkey", F.col("o_totalprice").alias("price"))),
        tasks.function("add", lambda n, df: df.withColumn("price", F.col("price") + n)),
        tasks.channel_out("out", root, fn=lambda k, df: df.withColumn("price", F.col("price") * k)),
    ]
    inject = Lifecycle("add", {"before_task_start": lambda context: {"params": (10,)}})
    _finish(Engine(spark), Job([("in", "add"), ("add", "out")], catalog, lifecycles=[inject], fn_params={"out": (3,)}))
    return _out(spark, root, "o_orderkey long, price double")


@query("SELECT * FROM (VALUES (1, 'start_task'), (2, 'start_task'), (3, 'before_task_start'), (4, 'before_batch'), (5, 'after_read_batch'), (6, 'after_apply_fn'), (7, 'after_batch'), (8, 'after_task_stop'), (9, 'handle_exception'), (10, 'after_task_stop')) AS t(place, call)")
def job_lifecycle_calls(spark, sf):
    """The calls around a task that is let start at the second try, and those around one that fails."""
    calls: list[str] = []

    def start(context):
        calls.append("start_task")
        return calls.count("start_task") > 1

    tell = lambda name, answer=None: lambda *a: calls.append(name) or answer
    hooks = {c: tell(c) for c in ("before_task_start", "before_batch", "after_read_batch", "after_apply_fn", "after_batch", "after_task_stop")}
    good = Job([("in", "out")], [tasks.literal("in", [(1,)], "n long"), tasks.null("out")], lifecycles=[Lifecycle("out", hooks | {"start_task": start})])
    _finish(Engine(spark), good)

    def fail(df):
        raise RuntimeError("no")

    bad = Job([("in", "out")], [good.catalog[0], Task("out", "output", sink=fail)], lifecycles=[Lifecycle("in", {"handle_exception": tell("handle_exception", "defer"), "after_task_stop": hooks["after_task_stop"]})])
    engine = Engine(spark)
    engine.await_job(engine.submit(bad)["job_id"])
    return spark.createDataFrame(list(enumerate(calls, 1)), "place int, call string")


@query("SELECT * FROM (VALUES ('submit', 'true'), ('await', 'true'), ('state', 'completed'), ('same job again', 'true'), ('other job, same id', 'incorrect-job-hash'), ('kill ended job', 'false'), ('unknown task', 'false'), ('history', 'one'), ('name', 'one'), ('log', 'submit-job,job-completed'), ('gc', '1'), ('state after gc', NULL)) AS t(call, answer)")
def job_control(spark, sf):
    engine, entries = Engine(spark), []
    engine.subscribe(lambda e: entries.append(e["entry"]))
    catalog = [tasks.literal("in", [(1,), (2,)], "n long"), tasks.effect("out", lambda row: None)]
    job, text = Job([("in", "out")], catalog, metadata={"job-id": "one", "job-name": "numbers"}), lambda x: str(x).lower()
    out = [("submit", text(engine.submit(job)["success"])), ("await", text(engine.await_job("one"))), ("state", engine.state("one")), ("same job again", text(engine.submit(job)["success"]))]
    out += [("other job, same id", engine.submit(Job([("in", "out")], [catalog[0], tasks.null("out")], metadata={"job-id": "one"})).get("error")), ("kill ended job", text(engine.kill("one")))]
    out += [("unknown task", text(engine.submit(Job([("in", "nowhere")], catalog))["success"])), ("history", ",".join(engine.history())), ("name", engine.named_snapshot("numbers")[0]), ("log", ",".join(entries))]
    return spark.createDataFrame([*out, ("gc", str(engine.gc())), ("state after gc", engine.state("one"))], "call string, answer string")


# -- windows, triggers and conditions of whole jobs


def _reduced(spark, sf, window: Window, trigger: Trigger, group="event_type") -> DataFrame:
    catalog = [Task("in", "input", source=sources.frame(_events(spark, sf).select("event_id", "event_type", "user_id", "ts", "value"))), Task("sum", "reduce", group_by_key=group, flux_policy="continue", seq="event_id"), Task("out", "output")]
    return plan(spark, Job([("in", "sum"), ("sum", "out")], catalog, windows=[window], triggers=[trigger])).outputs["out"]


_NTH = "FROM (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events)"


@query(f"SELECT event_type, event_id AS fire_seq, CAST(c AS VARCHAR) AS state {_NTH} WHERE c % 2 = 0")
def job_custom_trigger(spark, sf):
    second = CustomTrigger(0, lambda t, state, event: state + 1, lambda t, state, event, extent: event["type"] == "new-segment" and state % 2 == 0)
    return _reduced(spark, sf, Window("w", "sum", "global", "count"), Trigger("g", "w", second, emit=lambda df: df)).select("event_type", "fire_seq", "state")


@query(f"SELECT event_type, event_id AS fire_seq, CAST(c % 7 AS VARCHAR) AS state {_NTH} WHERE c % 5 = 0 UNION ALL SELECT event_type, NULL, CAST(((n - n % 5) % 7 + n % 5) % 7 AS VARCHAR) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def job_refinement(spark, sf):
    """A count that each fire takes modulo 7, and goes on from; completion fires, too."""
    trigger = Trigger("g", "w", "segment", threshold=(5, "elements"), refinement=lambda s: s % 7, emit=lambda df: df)
    return _reduced(spark, sf, Window("w", "sum", "global", "count"), trigger).select("event_type", "fire_seq", "state")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS state FROM events GROUP BY event_type")
def job_timer_at_completion(spark, sf):
    """A timer's period doesn't pass within bounded data; it fires when the job completes."""
    return _reduced(spark, sf, Window("w", "sum", "global", "count"), Trigger("g", "w", "timer", period=(1, "hour"), emit=lambda df: df)).select("event_type", "state")


@query(_fixed_sql("CAST(count(*) AS BIGINT) AS state"))
def job_terminal_reduce(spark, sf):
    """A reduce task without outputs: its trigger's sync is all that happens."""
    root = shared.folder(spark, "sync")
    catalog = [Task("in", "input", source=sources.frame(_events(spark, sf))), Task("sum", "reduce", group_by_key="event_type", flux_policy="continue")]
    sync = Trigger("g", "w", "watermark", state_context=("window-state",), sync=lambda df: df.write.parquet(root))
    _finish(Engine(spark), Job([("in", "sum")], catalog, windows=[Window("w", "sum", "fixed", "count", window_key="ts", range=DAY)], triggers=[sync]))
    return _out(spark, root, "event_type string, lower_ms long, upper_ms long, state long")


@query("""WITH e AS (SELECT 'segment' AS kind, event_id, event_type, NULL::BIGINT AS n FROM events UNION ALL SELECT 'all', NULL, event_type, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'day', NULL, event_type, count(*) FROM events GROUP BY event_type, (epoch_us(ts) // 1000) // 86400000)
SELECT 'out' AS edge, * FROM e UNION ALL SELECT 'large' AS edge, * FROM e WHERE n >= 5""")
def job_windows_on_function(spark, sf):
    """Two windows on a function task: segments pass, releases of both join them, and flow conditions route them all."""
    emit = lambda kind: lambda df: df.select(F.lit(kind).alias("kind"), "event_type", F.col("state").alias("n"))
    catalog = [Task("in", "input", source=sources.frame(_events(spark, sf).select("event_id", "event_type", "ts"))), Task("pass", "function", fn=lambda df: df.withColumn("kind", F.lit("segment")), group_by_key="event_type", flux_policy="continue"), Task("out", "output"), Task("large", "output")]
    windows = [Window("all", "pass", "global", "count"), Window("day", "pass", "fixed", "count", window_key="ts", range=DAY)]
    triggers = [Trigger("g", w.id, "watermark", state_context=("window-state",), emit=emit(w.id)) for w in windows]
    large = lambda event, old, new, all_new: new["n"] >= 5
    conditions = [FlowCondition("pass", ["large"], large), FlowCondition("pass", ["out"], always)]
    out = plan(spark, Job([("in", "pass"), ("pass", "out"), ("pass", "large")], catalog, conditions, windows, triggers)).outputs
    parts = [df.select(F.lit(e).alias("edge"), "kind", "event_id", "event_type", "n") for e, df in out.items()]
    return parts[0].union(parts[1])


@query("SELECT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events GROUP BY ALL")
def window_ordered_log(spark, sf):
    window = Window("w", "t", "fixed", ("collect-key-value", "event_type"), window_key="ts", range=DAY, storage_strategy=("ordered-log",))
    return aggregate(_events(spark, sf), window, ["user_id"], ["event_id"]).select("user_id", "lower_ms", F.array_join("state", ">").alias("path"))


@query("SELECT DISTINCT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, ((epoch_us(ts) // 1000) // 86400000) * 86400000 + 86399999 AS upper_ms FROM events")
def window_extents_only(spark, sf):
    return aggregate(_events(spark, sf), Window("w", "t", "fixed", "count", window_key="ts", range=DAY, storage_strategy=("extents",)), ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id, event_type, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms FROM events)
SELECT a.user_id, a.lower_ms, a.event_id AS click, b.event_id AS purchase FROM e a JOIN e b ON a.user_id = b.user_id AND a.lower_ms = b.lower_ms WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def window_join(spark, sf):
    side = lambda kind: _events(spark, sf).where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(kind))
    out = patterns.windowed_join(side("click"), side("purchase"), ["user_id"], Window("w", "t", "fixed", "count", window_key="ts", range=DAY))
    return out.select("user_id", "lower_ms", "click", "purchase")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")
def flow_from_all(spark, sf):
    """A condition from all tasks, to all of each one's edges."""
    dear = lambda event, old, new, all_new: new["o_totalprice"] >= 100_000
    condition = FlowCondition("all", "all", dear, short_circuit=True)
    return _through(spark, _orders(spark, sf).select("o_orderkey", "o_totalprice"), tasks.function("same", lambda df: df), [condition])["out"].select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice >= 100000)")
def flow_retry(spark, sf):
    """Segments that a condition would have retried are gone, as the action has no effect of its own."""
    dear = lambda event, old, new, all_new: new["o_totalprice"] >= 100_000
    conditions = [FlowCondition("same", "none", dear, short_circuit=True, action="retry"), FlowCondition("same", ["out"], always)]
    return _through(spark, _orders(spark, sf).select("o_orderkey", "o_totalprice"), tasks.function("same", lambda df: df), conditions)["out"].select("o_orderkey")


@query(_edge_sql(("good", "c_custkey % 3 > 0"), ("also", "c_custkey % 3 > 0"), ("bad", "c_custkey % 3 = 0")))
def flow_only_exceptions(spark, sf):
    """With conditions on exceptions alone, what goes well takes the edges that they don't name."""

    def touchy(row):
        if row["c_custkey"] % 3 == 0:
            raise ValueError("three")
        return {"c_custkey": row["c_custkey"]}

    fix = lambda event, rows, error: rows.select(F.col("_old.c_custkey").alias("c_custkey"))

    def failed(event, old, new, all_new):
        return old["c_custkey"].isNotNull()

    failed.reads_old = True
    condition = FlowCondition("touch", ["bad"], failed, short_circuit=True, thrown_exception=True, post_transform=fix)
    return _edges(_through(spark, _read("customer")(spark, sf).select("c_custkey"), Task("touch", "function", fn=touchy, schema="c_custkey long"), [condition], ["good", "also", "bad"]), "c_custkey")


@query("SELECT o_orderkey, o_totalprice / power(2, greatest(0, floor(log2(o_totalprice / 1000)) + 1)) AS price FROM orders")
def batch_iterate(spark, sf):
    """Halves prices until all are below 1000."""
    over = F.col("price") >= 1000
    step = lambda df: df.withColumn("price", F.when(over, F.col("price") / 2).otherwise(F.col("price")))
    return batch.iterate(_orders(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("price")), step, lambda df: df.where(over).isEmpty())


# -- streams


@query(_fixed_sql("CAST(count(*) AS BIGINT) AS state"))
def stream_late_data(spark, sf):
    """Four micro-batches with events of all days each: late ones update their extents."""
    root = shared.folder(spark, "late")
    _events(spark, sf).repartition(4, "event_id").write.parquet(root)
    stream = sources.stream_files(root, _events(spark, sf).schema, max_files=1)(spark)
    out = drain(windowed(stream, Window("w", "t", "fixed", "count", window_key="ts", range=DAY), ["event_type"]), "late", "update")
    return out.groupBy("event_type", "lower_ms", "upper_ms").agg(F.max("state").alias("state"))


def _counting(name: str, source, sink: str, **more) -> Job:
    catalog = [Task("in", "input", source=source), Task("sum", "reduce", group_by_key="event_type", flux_policy="continue", seq="event_id"), tasks.channel_out("out", sink)]
    trigger = Trigger("g", "w", "segment", threshold=(5, "elements"), emit=lambda df: df)
    return Job([("in", "sum"), ("sum", "out")], catalog, windows=[Window("w", "sum", "global", "count")], triggers=[trigger], metadata={"job-id": name}, **more)


@query(f"SELECT event_type, event_id AS fire_seq, CAST(c AS VARCHAR) AS state {_NTH} WHERE c % 5 = 0")
def job_resume(spark, sf):
    """A job over the first half of a stream, and another that resumes its offsets and state over the rest."""
    root = shared.folder(spark, "resume")
    events = _events(spark, sf).select("event_id", "event_type")
    half = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    source = sources.stream_files(f"{root}/in", events.schema)
    engine = Engine(spark, f"{root}/checkpoints")
    events.where(F.col("event_id") <= half).write.parquet(f"{root}/in")
    _finish(engine, _counting("first", source, f"{root}/out"))
    events.where(F.col("event_id") > half).write.mode("append").parquet(f"{root}/in")
    _finish(engine, _counting("second", source, f"{root}/out", resume_point=engine.resume_point("first")))
    return _out(spark, f"{root}/out", "event_type string, lower_ms long, upper_ms long, fire_seq long, state string").select("event_type", "fire_seq", "state")


@query("SELECT event_type, CAST(count(*) AS VARCHAR) AS state FROM events GROUP BY event_type")
def job_window_state(spark, sf):
    """The extents that a stream's job holds, read from its state store."""
    root = shared.folder(spark, "state")
    engine = Engine(spark, f"{root}/checkpoints")
    _finish(engine, _counting("job", sources.frame(_stream(spark, sf).select("event_id", "event_type")), f"{root}/out"))
    return engine.window_state("job", "out").select("group.event_type", "state")

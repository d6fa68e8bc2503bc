"""The engine's queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sources
from millrace.model import FlowCondition, Job, Task, Trigger, Window
from millrace.operators import batch, patterns
from millrace.operators.aggregations import Aggregation
from millrace.operators.triggers import replay
from millrace.operators.windows import aggregate
from millrace.plans.planner import plan
from millrace.streaming.fold import CustomTrigger
from millrace.streaming.processors import drain, triggered, windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY, HOUR = (1, "day"), 3_600_000


def query(sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _read(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


_events, _lineitem, _orders, _customer = map(_read, ("events", "lineitem", "orders", "customer"))


def _through(spark: SparkSession, df: DataFrame, task: Task, conditions=(), outs=("out",)) -> dict[str, DataFrame]:
    """One function task between an input and some outputs, planned as a job."""
    catalog = [Task("in", "input", source=sources.frame(df)), task, *(Task(o, "output") for o in outs)]
    return plan(spark, Job([("in", task.name), *((task.name, o) for o in outs)], catalog, conditions)).outputs


def _edges(outputs: dict[str, DataFrame], *columns: str) -> DataFrame:
    """The outputs of all edges in one table, with the edge's name."""
    parts = [df.select(F.lit(e).alias("edge"), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)) for e, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# -- transforms


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def map_fn(spark, sf):
    net = lambda df: df.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))
    return _through(spark, _lineitem(spark, sf), Task("net", "function", fn=net))["out"]


@query("SELECT event_id, CAST(i AS INTEGER) AS i FROM (SELECT event_id, unnest(range(event_id % 3)) AS i FROM events)")
def flatmap_fn(spark, sf):
    spread = lambda df: df.select("event_id", F.explode(F.when(F.col("event_id") % 3 > 0, F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int") - 1))).alias("i"))
    return _through(spark, _events(spark, sf), Task("spread", "function", fn=spread))["out"]


def _halves(rows: list[dict]) -> list[dict]:
    return [{"o_orderkey": r["o_orderkey"], "half": r["o_totalprice"] / 2} for r in rows]


@query("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders")
def batch_fn(spark, sf):
    return _through(spark, _orders(spark, sf).select("o_orderkey", "o_totalprice"), Task("half", "function", fn=_halves, batch_fn=True, batch_size=500, schema="o_orderkey long, half double"))["out"]


@query("SELECT o_orderkey, o_totalprice + 10 * 3 AS shifted FROM orders")
def param_fn(spark, sf):
    shift = lambda a, b, df: df.select("o_orderkey", (F.col("o_totalprice") + F.lit(a * b)).alias("shifted"))
    return _through(spark, _orders(spark, sf), Task("shift", "function", fn=shift, params=(10, 3)))["out"]


@query("SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def fan_in_union(spark, sf):
    catalog = [
        Task("customers", "input", source=sources.frame(_customer(spark, sf).select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")))),
        Task("suppliers", "input", source=sources.frame(_read("supplier")(spark, sf).select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))),
        Task("all", "output"),
    ]
    return plan(spark, Job([("customers", "all"), ("suppliers", "all")], catalog)).outputs["all"]


@query("SELECT o_orderkey, 1 AS way FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders")
def diamond_dag(spark, sf):
    way = lambda n: lambda df: df.select("o_orderkey", F.lit(n).alias("way"))
    catalog = [Task("in", "input", source=sources.frame(_orders(spark, sf))), Task("a", "function", fn=way(1)), Task("b", "function", fn=way(2)), Task("out", "output")]
    return plan(spark, Job([("in", "a"), ("in", "b"), ("a", "out"), ("b", "out")], catalog)).outputs["out"]


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def text_lines(spark, sf):
    lines = lambda df: df.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return _through(spark, _read("documents")(spark, sf), Task("lines", "function", fn=lines))["out"]


# -- grouping and windows


def _windowed(df: DataFrame, groups=(), seq=(), **window) -> DataFrame:
    return aggregate(df, Window("w", "t", **window), groups, seq)


def _fixed_sql(state: str, where: str = "") -> str:
    return f"SELECT event_type, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, ((epoch_us(ts) // 1000) // 86400000) * 86400000 + 86399999 AS upper_ms, {state} FROM events {where} GROUP BY ALL"


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS state FROM events GROUP BY event_type")
def group_by_key(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="global", aggregation="count").drop("lower_ms", "upper_ms")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 4) AS average FROM lineitem GROUP BY ALL")
def group_by_keys(spark, sf):
    out = _windowed(_lineitem(spark, sf), ["l_returnflag", "l_linestatus"], type="global", aggregation=("average", "l_quantity"))
    return out.select("l_returnflag", "l_linestatus", "n", F.round("sum", 4).alias("sum"), F.round("average", 4).alias("average"))


@query("SELECT user_id % 7 AS group_key, CAST(count(*) AS BIGINT) AS state FROM events GROUP BY ALL")
def group_by_fn(spark, sf):
    from millrace.operators.grouping import grouped

    df, keys = grouped(_events(spark, sf), Task("t", "reduce", group_by_fn=lambda df: F.col("user_id") % 7, flux_policy="continue"))
    return _windowed(df, keys, type="global", aggregation="count").drop("lower_ms", "upper_ms")


@query(_fixed_sql("CAST(count(*) AS BIGINT) AS state"))
def fixed_count(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="fixed", window_key="ts", range=DAY, aggregation="count")


@query(_fixed_sql("round(coalesce(sum(value), 0), 4) AS state"))
def fixed_sum(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="fixed", window_key="ts", range=DAY, aggregation=("sum", "value")).withColumn("state", F.round("state", 4))


@query(_fixed_sql("least(10.0::DOUBLE, min(value)) AS state"))
def fixed_min_init(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="fixed", window_key="ts", range=DAY, aggregation=("min", "value"), init=10.0)


@query(_fixed_sql("greatest(10.0::DOUBLE, max(value)) AS state"))
def fixed_max_init(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="fixed", window_key="ts", range=DAY, aggregation=("max", "value"), init=10.0)


@query(_fixed_sql("CAST(count(value) AS BIGINT) AS n, round(coalesce(sum(value), 0), 4) AS sum, abs(sum(value) / count(value) * count(value) - sum(value)) < 1e-6 AS average_fits"))
def fixed_average(spark, sf):
    """The average is told by the count and the sum: rounded, it can lie halfway between two numbers of four places."""
    out = _windowed(_events(spark, sf), ["event_type"], type="fixed", window_key="ts", range=DAY, aggregation=("average", "value"))
    return out.select("event_type", "lower_ms", "upper_ms", "n", F.round("sum", 4).alias("sum"), (F.abs(F.col("average") * F.col("n") - F.col("sum")) < 1e-6).alias("average_fits"))


@query("WITH w AS (SELECT CAST(floor((event_id - 50) / 120) AS BIGINT) AS w FROM events) SELECT greatest(50, 50 + w * 120) AS lower_ms, 50 + w * 120 + 119 AS upper_ms, CAST(count(*) AS BIGINT) AS state FROM w GROUP BY ALL")
def fixed_min_value(spark, sf):
    return _windowed(_events(spark, sf), type="fixed", window_key="event_id", range=(120, "elements"), min_value=50, aggregation="count")


def _sliding_sql(range_: int, slide: int, key: str, table: str, groups: str = "") -> str:
    return f"""WITH w AS (SELECT {groups} unnest(range({key} // {slide}, ({key} + {range_}) // {slide})) AS w FROM {table})
SELECT {groups} greatest(0, (w + 1) * {slide} - {range_}) AS lower_ms, (w + 1) * {slide} - 1 AS upper_ms, CAST(count(*) AS BIGINT) AS state FROM w GROUP BY ALL"""


@query(_sliding_sql(6 * HOUR, 2 * HOUR, "(epoch_us(ts) // 1000)", "events", "event_type,"))
def sliding_count(spark, sf):
    return _windowed(_events(spark, sf), ["event_type"], type="sliding", window_key="ts", range=(6, "hours"), slide=(2, "hours"), aggregation="count")


@query(_sliding_sql(150, 100, "event_id", "events"))
def sliding_uneven(spark, sf):
    return _windowed(_events(spark, sf), type="sliding", window_key="event_id", range=(150, "elements"), slide=(100, "elements"), aggregation="count")


@query("SELECT (l_partkey // 50) * 50 AS lower_ms, (l_partkey // 50) * 50 + 49 AS upper_ms, round(sum(l_quantity), 4) AS state FROM lineitem GROUP BY ALL")
def elements_window(spark, sf):
    return _windowed(_lineitem(spark, sf), type="fixed", window_key="l_partkey", range=(50, "elements"), aggregation=("sum", "l_quantity")).withColumn("state", F.round("state", 4))


@query("SELECT round(sum(o_totalprice), 2) AS state FROM orders")
def global_sum(spark, sf):
    return _windowed(_orders(spark, sf), type="global", aggregation=("sum", "o_totalprice")).select(F.round("state", 2).alias("state"))


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 2) AS average FROM orders GROUP BY ALL")
def global_average_grouped(spark, sf):
    out = _windowed(_orders(spark, sf), ["o_orderpriority"], type="global", aggregation=("average", "o_totalprice"))
    return out.select("o_orderpriority", "n", F.round("sum", 2).alias("sum"), F.round("average", 2).alias("average"))


_SESSIONS = """WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS t FROM events), l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 21600000 THEN 0 ELSE 1 END AS f FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS s FROM l)
SELECT user_id, min(t) AS lower_ms, max(t) AS upper_ms, {} AS state FROM s GROUP BY user_id, s"""


@query(_SESSIONS.format("CAST(count(*) AS BIGINT)"))
def session_count(spark, sf):
    return _windowed(_events(spark, sf), ["user_id"], type="session", window_key="ts", timeout_gap=(6, "hours"), aggregation="count")


@query(_SESSIONS.format("round(sum(value), 4)"))
def session_sum(spark, sf):
    return _windowed(_events(spark, sf), ["user_id"], type="session", window_key="ts", timeout_gap=(6, "hours"), aggregation=("sum", "value")).withColumn("state", F.round("state", 4))


@query("""WITH p AS (SELECT DISTINCT l_partkey * 7 + 100 * (l_partkey // 4) AS k FROM lineitem), l AS (SELECT k, CASE WHEN k - lag(k) OVER (ORDER BY k) <= 14 THEN 0 ELSE 1 END AS f FROM p),
s AS (SELECT k, sum(f) OVER (ORDER BY k) AS s FROM l) SELECT min(k) AS lower_ms, max(k) AS upper_ms, CAST(count(*) AS BIGINT) AS state FROM s GROUP BY s""")
def session_elements(spark, sf):
    keys = _lineitem(spark, sf).select((F.col("l_partkey") * 7 + 100 * F.floor(F.col("l_partkey") / 4)).alias("k")).distinct()
    return _windowed(keys, type="session", window_key="k", timeout_gap=(14, "elements"), aggregation="count")


@query("SELECT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def conj_ordered(spark, sf):
    out = _windowed(_events(spark, sf), ["user_id"], ["event_id"], type="fixed", window_key="ts", range=DAY, aggregation="conj")
    return out.select("user_id", "lower_ms", F.array_join(F.transform("state", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("SELECT user_id, event_type, CAST(count(DISTINCT event_id) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first FROM events WHERE event_type IS NOT NULL GROUP BY ALL")
def collect_by_key(spark, sf):
    out = _windowed(_events(spark, sf), ["user_id"], type="global", aggregation=("collect-by-key", "event_type"))
    out = out.select("user_id", F.explode("state").alias("event_type", "rows"))
    return out.select("user_id", "event_type", F.size("rows").cast("long").alias("n"), F.array_min(F.transform("rows", lambda x: x["event_id"])).alias("first"))


@query("SELECT event_type, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS users FROM events GROUP BY ALL")
def collect_key_value(spark, sf):
    out = _windowed(_events(spark, sf), ["event_type"], ["event_id"], type="fixed", window_key="ts", range=DAY, aggregation=("collect-key-value", "user_id"))
    return out.select("event_type", "lower_ms", F.array_join(F.transform("state", lambda x: x.cast("string")), ",").alias("users"))


@query("SELECT user_id, max_by(event_type, ((epoch_us(ts) // 1000), event_id)) AS state FROM events GROUP BY user_id")
def set_value(spark, sf):
    return _windowed(_events(spark, sf), ["user_id"], ["ts", "event_id"], type="global", aggregation=("set-value", "event_type")).select("user_id", "state")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY (epoch_us(ts) // 1000), event_id) AS path FROM events GROUP BY user_id")
def ordered_log_fold(spark, sf):
    out = _windowed(_events(spark, sf), ["user_id"], ["ts", "event_id"], type="global", storage_strategy=("ordered-log",), aggregation=("collect-key-value", "event_type"))
    return out.select("user_id", F.array_join("state", ">").alias("path"))


def _rise(a: dict, b: dict) -> dict:
    """Steps of two runs of values, one after the other: a run is its first and last value and its largest step up."""
    if a["n"] == 0 or b["n"] == 0:
        return b if a["n"] == 0 else a
    steps = [a["rise"], b["rise"]] + ([b["first"] - a["last"]] if a["last"] is not None and b["first"] is not None else [])
    return {"n": a["n"] + b["n"], "first": a["first"], "last": b["last"], "rise": max(steps)}


#: A user's aggregation: the largest step up from one event's value to the next.
RISE = Aggregation(create=lambda s: {"n": 1, "first": s["value"], "last": s["value"], "rise": 0.0}, apply=_rise, merge=_rise, schema="struct<n:long,first:double,last:double,rise:double>", init=lambda: {"n": 0, "first": None, "last": None, "rise": 0.0})


@query("WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, round(greatest(0, coalesce(max(d), 0)), 4) AS rise FROM d GROUP BY user_id")
def user_aggregation(spark, sf):
    out = _windowed(_events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], type="global", aggregation=RISE)
    return out.select("user_id", F.round("state.rise", 4).alias("rise"))


# -- flow conditions


def balance_over(event, old, new, all_new, least):
    return new["c_acctbal"] >= least


def segment_is(event, old, new, all_new, name):
    return new["c_mktsegment"] == name


def always(event, old, new, all_new):
    return F.lit(True)


def _flow(spark, sf, conditions, outs, *columns) -> DataFrame:
    return _edges(_through(spark, _customer(spark, sf), Task("split", "function", fn=lambda df: df), conditions, outs), *columns)


def _fc(to, predicate, short=False, **more) -> FlowCondition:
    return FlowCondition("split", to, predicate, short_circuit=short, **more)


def _edge_sql(*parts: tuple[str, str], columns: str = "c_custkey") -> str:
    return " UNION ALL ".join(f"SELECT '{e}' AS edge, {columns} FROM customer WHERE {w}" for e, w in parts)


@query(_edge_sql(("poor", "c_acctbal < 1000"), ("rich", "c_acctbal >= 5000"), ("rich_builders", "c_acctbal >= 5000 AND c_mktsegment = 'BUILDING'"), ("everyone", "true")))
def flow_people(spark, sf):
    rich, builder = [balance_over, "least"], [segment_is, "name"]
    p = {"least": 5000, "name": "BUILDING"}
    c = [_fc(["poor"], ["not", [balance_over, "least"]], params={"least": 1000}), _fc(["rich"], rich, params=p), _fc(["rich_builders"], ["and", rich, builder], params=p), _fc(["everyone"], always)]
    return _flow(spark, sf, c, ["poor", "rich", "rich_builders", "everyone"], "c_custkey")


@query(_edge_sql(("a", "c_mktsegment = 'BUILDING' OR c_acctbal >= 5000"), ("b", "c_acctbal >= 5000")))
def flow_union(spark, sf):
    return _flow(spark, sf, [_fc(["a"], [segment_is, "name"], params={"name": "BUILDING"}), _fc(["a", "b"], [balance_over, "least"], params={"least": 5000})], ["a", "b"], "c_custkey")


@query(_edge_sql(("a", "c_mktsegment = 'BUILDING'"), ("b", "c_mktsegment IS DISTINCT FROM 'BUILDING' AND c_acctbal >= 5000")))
def flow_short_circuit(spark, sf):
    return _flow(spark, sf, [_fc(["a"], [segment_is, "name"], True, params={"name": "BUILDING"}), _fc(["b"], [balance_over, "least"], params={"least": 5000})], ["a", "b"], "c_custkey")


@query(_edge_sql(("a", "c_acctbal >= 9000 OR c_mktsegment = 'BUILDING'"), ("b", "c_acctbal >= 9000")))
def flow_all(spark, sf):
    return _flow(spark, sf, [_fc("all", [balance_over, "least"], True, params={"least": 9000}), _fc(["a"], [segment_is, "name"], params={"name": "BUILDING"})], ["a", "b"], "c_custkey")


@query(_edge_sql(("a", "c_acctbal < 9000"), ("b", "c_acctbal < 9000 AND c_mktsegment = 'BUILDING'")))
def flow_none(spark, sf):
    return _flow(spark, sf, [_fc("none", [balance_over, "least"], True, params={"least": 9000}), _fc(["a"], always), _fc(["b"], [segment_is, "name"], params={"name": "BUILDING"})], ["a", "b"], "c_custkey")


@query(_edge_sql(("a", "NOT (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')")))
def flow_not_or(spark, sf):
    named = lambda n: [lambda e, o, s, a, k=n: s["c_mktsegment"] == k]
    return _flow(spark, sf, [_fc(["a"], ["not", ["or", named("BUILDING"), named("MACHINERY")]])], ["a"], "c_custkey")


@query(_edge_sql(("a", "true"), columns="c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name"))
def flow_exclude(spark, sf):
    return _flow(spark, sf, [_fc(["a"], [segment_is, "name"], params={"name": "BUILDING"}, exclude_keys=["c_name"]), _fc(["a"], always)], ["a"], "c_custkey", "c_name")


@query(_edge_sql(("a", "c_mktsegment = 'BUILDING'"), ("b", "c_mktsegment = 'MACHINERY'")))
def flow_nomatch_drop(spark, sf):
    return _flow(spark, sf, [_fc(["a"], [segment_is, "x"], params={"x": "BUILDING"}), _fc(["b"], [segment_is, "x"], params={"x": "MACHINERY"})], ["a", "b"], "c_custkey")


def picky(row: dict) -> dict:
    if row["o_orderkey"] % 2 == 0:
        raise ValueError(f"even {row['o_orderkey']}")
    return {"o_orderkey": row["o_orderkey"], "next": row["o_orderkey"] + 1}


def as_error(event, rows, error):
    return rows.select(F.col("_old.o_orderkey").alias("o_orderkey") if "_old" in rows.columns else F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("long").alias("next"), F.col(f"{error}.message").alias("message"))


@query("SELECT 'good' AS edge, o_orderkey, o_orderkey + 1 AS next, NULL AS message FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'bad', NULL, NULL, 'even ' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def flow_exception(spark, sf):
    is_value_error = lambda event, old, new, all_new: new["type"] == "ValueError"
    conditions = [FlowCondition("pick", ["bad"], is_value_error, thrown_exception=True, short_circuit=True, post_transform=as_error), FlowCondition("pick", ["good"], always)]
    task = Task("pick", "function", fn=picky, schema="o_orderkey long, next long")
    return _edges(_through(spark, _orders(spark, sf).select("o_orderkey"), task, conditions, ["good", "bad"]), "o_orderkey", "next", "message").withColumns({"o_orderkey": F.col("o_orderkey").cast("long"), "next": F.col("next").cast("long")})


def touchy(event, old, new, all_new) -> bool:
    if new["o_orderkey"] % 5 == 0:
        raise KeyError("five")
    return new["o_orderkey"] % 2 == 1


@query("SELECT 'good' AS edge, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 > 0 UNION ALL SELECT 'bad', o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def flow_pred_error(spark, sf):
    fix = lambda event, rows, error: rows.select("new.o_orderkey")
    condition = FlowCondition("look", ["good"], touchy, predicate_errors_to=["bad"], post_transform=fix)
    return _edges(_through(spark, _orders(spark, sf).select("o_orderkey"), Task("look", "function", fn=lambda df: df), [condition], ["good", "bad"]), "o_orderkey")


@query(_edge_sql(("good", "c_custkey % 5 > 0 AND c_custkey % 2 = 1"), ("other", "c_acctbal >= 5000"), ("last", "c_custkey % 5 > 0"), ("bad", "c_custkey % 5 = 0")))
def flow_pred_error_with_others(spark, sf):
    """A predicate that raises beside conditions before and after it; what is left of a failed segment takes the edges so far."""

    def odd(event, old, new, all_new):
        if new["c_custkey"] % 5 == 0:
            raise KeyError("five")
        return new["c_custkey"] % 2 == 1

    fix = lambda event, rows, error: rows.select("new.c_custkey")
    conditions = [_fc(["other"], [balance_over, "least"], params={"least": 5000}), FlowCondition("split", ["good"], odd, predicate_errors_to=["bad"], post_transform=fix), _fc(["last"], always)]
    return _edges(_through(spark, _customer(spark, sf), Task("split", "function", fn=lambda df: df.select("c_custkey", "c_acctbal")), conditions, ["good", "other", "last", "bad"]), "c_custkey")


@query(_edge_sql(("a", "c_custkey % 5 = 0 OR c_custkey % 2 = 1"), ("out", "c_custkey % 5 = 0"), ("rest", "c_custkey % 5 = 0")))
def flow_pred_error_to_all(spark, sf):
    def odd(event, old, new, all_new, n):
        if new["c_custkey"] % n == 0:
            raise ValueError("divisible")
        return new["c_custkey"] % 2 == 1

    fix = lambda event, rows, error: rows.select("new.c_custkey")
    condition = FlowCondition("split", ["a"], [odd, "n"], params={"n": 5}, predicate_errors_to="all", post_transform=fix)
    return _edges(_through(spark, _customer(spark, sf), Task("split", "function", fn=lambda df: df.select("c_custkey")), [condition], ["a", "out", "rest"]), "c_custkey")


# -- triggers


def _replayed(spark, sf, trigger, group="user_id", window=None, aggregation="count", completion=False) -> DataFrame:
    w = window or {"type": "fixed", "window_key": "ts", "range": DAY}
    df = _events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value")
    return replay(df, Window("w", "t", aggregation=aggregation, **w), trigger, [group], "event_id", completion)


def _segment(n, **more) -> Trigger:
    return Trigger("g", "w", "segment", threshold=(n, "elements"), emit=lambda df: df, **more)


_RUN = """WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
e AS (SELECT *, (t // 86400000) * 86400000 AS lower_ms FROM x)"""


@query(_RUN + " SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, c AS state FROM (SELECT *, count(*) OVER (PARTITION BY user_id, lower_ms ORDER BY event_id) AS c FROM e) WHERE rn % 5 = 0")
def trigger_segment(spark, sf):
    return _replayed(spark, sf, _segment(5))


@query(_RUN + " SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, round(s, 4) AS state FROM (SELECT e.*, sum(value) OVER (PARTITION BY e.user_id, lower_ms ORDER BY e.event_id) AS s FROM e JOIN events v ON v.event_id = e.event_id) WHERE rn % 5 = 0")
def trigger_segment_sum(spark, sf):
    return _replayed(spark, sf, _segment(5), aggregation=("sum", "value")).withColumn("state", F.round("state", 4))


@query(_RUN + " SELECT user_id, event_id AS fire_seq, n, round(s, 4) AS sum FROM (SELECT e.*, count(value) OVER w AS n, sum(value) OVER w AS s FROM e JOIN events v ON v.event_id = e.event_id WINDOW w AS (PARTITION BY e.user_id ORDER BY e.event_id)) WHERE rn % 7 = 0")
def trigger_segment_average(spark, sf):
    return _replayed(spark, sf, _segment(7), window={"type": "global"}, aggregation=("average", "value")).select("user_id", "fire_seq", "n", F.round("sum", 4).alias("sum"))


@query(_RUN + " SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, greatest(10.0::DOUBLE, m) AS state FROM (SELECT e.*, max(value) OVER (PARTITION BY e.user_id, lower_ms ORDER BY e.event_id) AS m FROM e JOIN events v ON v.event_id = e.event_id) WHERE rn % 5 = 0")
def trigger_segment_max(spark, sf):
    w = {"type": "fixed", "window_key": "ts", "range": DAY, "init": 10.0}
    return _replayed(spark, sf, _segment(5), window=w, aggregation=("max", "value"))


@query(_RUN + """, r AS (SELECT *, count(*) OVER (PARTITION BY user_id, lower_ms ORDER BY event_id) AS c FROM e), f AS (SELECT user_id, event_id AS fire_seq, rn AS frn FROM x WHERE rn % 5 = 0)
SELECT f.user_id, lower_ms, lower_ms + 86399999 AS upper_ms, fire_seq, max_by(c, rn) AS state FROM f JOIN r ON r.user_id = f.user_id AND r.rn <= frn GROUP BY f.user_id, lower_ms, fire_seq""")
def trigger_segment_all(spark, sf):
    return _replayed(spark, sf, _segment(5, fire_all_extents=True))


@query(_RUN + """, p AS (SELECT *, coalesce(sum(CASE WHEN rn % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, lower_ms ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM e)
SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, c AS state FROM (SELECT *, count(*) OVER (PARTITION BY user_id, lower_ms, ep ORDER BY event_id) AS c FROM p) WHERE rn % 5 = 0""")
def trigger_segment_evict(spark, sf):
    return _replayed(spark, sf, _segment(5, post_evictor="all"))


@query(_RUN + """, p AS (SELECT *, (rn - 1) // 5 AS ep FROM e), last AS (SELECT user_id, ep, max(event_id) AS last, count(*) AS n FROM p GROUP BY user_id, ep)
SELECT p.user_id, lower_ms, lower_ms + 86399999 AS upper_ms, CASE WHEN n = 5 THEN last END AS fire_seq, CAST(count(*) AS BIGINT) AS state FROM p JOIN last ON last.user_id = p.user_id AND last.ep = p.ep GROUP BY ALL""")
def trigger_segment_all_evict(spark, sf):
    return _replayed(spark, sf, _segment(5, fire_all_extents=True, post_evictor="all"), completion=True)


@query(_RUN + " SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, c AS state FROM (SELECT *, count(*) OVER (PARTITION BY user_id, lower_ms ORDER BY event_id) AS c FROM e) WHERE event_type = 'click'")
def trigger_punctuation(spark, sf):
    return _replayed(spark, sf, Trigger("g", "w", "punctuation", pred=lambda rn: F.col("event_type") == "click", emit=lambda df: df))


@query(_RUN + " SELECT user_id, lower_ms, lower_ms + 86399999 AS upper_ms, event_id AS fire_seq, c AS state FROM (SELECT *, count(*) OVER (PARTITION BY user_id, lower_ms ORDER BY event_id) AS c FROM e) WHERE t >= lower_ms + 0.75 * 86399999")
def trigger_percentile(spark, sf):
    return _replayed(spark, sf, Trigger("g", "w", "percentile-watermark", watermark_percentage=0.75, state_context=("window-state",), emit=lambda df: df))


@query("SELECT user_id, ((epoch_us(ts) // 1000) // 86400000) * 86400000 AS lower_ms, ((epoch_us(ts) // 1000) // 86400000) * 86400000 + 86399999 AS upper_ms, CAST(count(*) AS BIGINT) AS state FROM events GROUP BY ALL")
def trigger_watermark_final(spark, sf):
    return _replayed(spark, sf, Trigger("g", "w", "watermark", state_context=("window-state",), post_evictor="all", emit=lambda df: df))


@query("SELECT user_id, event_id AS fire_seq, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS state FROM events")
def running_count(spark, sf):
    return _replayed(spark, sf, _segment(1), window={"type": "global"}).select("user_id", "fire_seq", "state")


@query("SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type HAVING sum(value) > 0")
def reduce_emit(spark, sf):
    emit = lambda df: df.select("event_type", F.round("state", 4).alias("total")).where("total > 0")
    catalog = [Task("in", "input", source=sources.frame(_events(spark, sf))), Task("sum", "reduce", group_by_key="event_type", flux_policy="continue"), Task("out", "output")]
    windows = [Window("w", "sum", "global", ("sum", "value"))]
    return plan(spark, Job([("in", "sum"), ("sum", "out")], catalog, windows=windows, triggers=[Trigger("g", "w", "watermark", state_context=("window-state",), emit=emit)])).outputs["out"]


# -- patterns and whole-input operators


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def join_pattern(spark, sf):
    customers = _customer(spark, sf).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return patterns.pair_join(_orders(spark, sf), customers, ["o_custkey"]).select("o_orderkey", "o_totalprice", "c_name")


@query("WITH p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 2 AS p FROM events) SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM p GROUP BY user_id, p HAVING count(*) = 2")
def join_arrivals(spark, sf):
    return patterns.pair_arrivals(_events(spark, sf).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def lookup_pattern(spark, sf):
    nations = _read("nation")(spark, sf).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return patterns.lookup(_customer(spark, sf), nations, ["c_nationkey"]).select("c_custkey", "n_name")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_pattern(spark, sf):
    return patterns.dedupe(_events(spark, sf).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def batch_distinct(spark, sf):
    return batch.distinct(_lineitem(spark, sf).select("l_returnflag", "l_linestatus"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def batch_sort(spark, sf):
    return batch.sort(_orders(spark, sf).select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT l_suppkey AS key FROM lineitem INTERSECT SELECT s_suppkey FROM supplier")
def batch_intersection(spark, sf):
    return batch.intersection(_lineitem(spark, sf).select(F.col("l_suppkey").alias("key")), _read("supplier")(spark, sf).select(F.col("s_suppkey").alias("key")))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def batch_join(spark, sf):
    urgent = _orders(spark, sf).where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return batch.join(_lineitem(spark, sf), urgent, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("SELECT k AS nationkey, CAST(coalesce(c, 0) AS BIGINT) AS customers, CAST(coalesce(s, 0) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) USING (k)")
def batch_cogroup(spark, sf):
    import pandas as pd

    sizes = lambda key, a, b: pd.DataFrame([[key[0], len(a), len(b)]], columns=["nationkey", "customers", "suppliers"])
    a, b = _customer(spark, sf).select(F.col("c_nationkey").alias("k")), _read("supplier")(spark, sf).select(F.col("s_nationkey").alias("k"))
    return batch.cogroup(a, b, ["k"], sizes, "nationkey int, customers long, suppliers long")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def batch_cartesian(spark, sf):
    return batch.cartesian(_read("nation")(spark, sf).select("n_name"), _read("region")(spark, sf).select("r_name"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000)")
def batch_remove(spark, sf):
    return batch.remove(_orders(spark, sf), F.col("o_totalprice") > 100_000).select("o_orderkey")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey")
def batch_reduce(spark, sf):
    return batch.reduce_by_key(_orders(spark, sf), ["o_custkey"], n=F.count("*"), most=F.max("o_totalprice"))


@query()
def batch_sample(spark, sf):
    return batch.sample(_orders(spark, sf).select("o_orderkey"), 0.1, 7)


# -- streams


def _stream(spark: SparkSession, sf: str, name: str = "events") -> DataFrame:
    """The table as a stream of its files, through Spark's own readers."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return sources.stream_files(sf, schema, pathGlobFilter=f"{name}.parquet")(spark)


@query(_fixed_sql("CAST(count(*) AS BIGINT) AS state"))
def stream_fixed_count(spark, sf):
    out = windowed(_stream(spark, sf), Window("w", "t", "fixed", "count", window_key="ts", range=DAY), ["event_type"])
    return drain(out, "fixed", "complete")


@query(_sliding_sql(6 * HOUR, 2 * HOUR, "(epoch_us(ts) // 1000)", "events"))
def stream_sliding_count(spark, sf):
    out = windowed(_stream(spark, sf), Window("w", "t", "sliding", "count", window_key="ts", range=(6, "hours"), slide=(2, "hours")))
    return drain(out, "sliding", "complete")


@query(_SESSIONS.format("CAST(count(*) AS BIGINT)"))
def stream_session_count(spark, sf):
    out = windowed(_stream(spark, sf), Window("w", "t", "session", "count", window_key="ts", timeout_gap=(6, "hours")), ["user_id"])
    return drain(out, "session", "complete")


@query("SELECT event_type, event_id AS fire_seq, CAST(c AS VARCHAR) AS state FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events) WHERE c % 5 = 0")
def stream_segment_trigger(spark, sf):
    out = triggered(_stream(spark, sf).select("event_id", "event_type"), Window("w", "t", "global", "count"), _segment(5), ["event_type"], "event_id")
    return drain(out.select("event_type", "fire_seq", "state"), "segment", "update")


def _streamed_job(spark, sf, window: Window, trigger: Trigger, name: str, mode: str, group: str = "event_type") -> DataFrame:
    """A planned job over a stream: its reduce task's releases, run over what there is."""
    catalog = [Task("in", "input", source=sources.frame(_stream(spark, sf).select("event_id", "event_type", "user_id", "ts", "value"))), Task("sum", "reduce", group_by_key=group, flux_policy="continue", seq="event_id"), Task("out", "output")]
    out = plan(spark, Job([("in", "sum"), ("sum", "out")], catalog, windows=[window], triggers=[trigger])).outputs["out"]
    return drain(out, name, mode)


@query("SELECT event_type, event_id AS fire_seq, CAST(c AS VARCHAR) AS state FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events) WHERE c % 9 = 0")
def stream_job_segment(spark, sf):
    return _streamed_job(spark, sf, Window("w", "sum", "global", "count"), _segment(9), "job_segment", "update").select("event_type", "fire_seq", "state")


@query("SELECT event_type, event_id AS fire_seq, CAST(c AS VARCHAR) AS state FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events) WHERE user_id % 10 = 0")
def stream_job_punctuation(spark, sf):
    trigger = Trigger("g", "w", "punctuation", pred=lambda t, event: event["type"] == "new-segment" and event["segment"]["user_id"] % 10 == 0, emit=lambda df: df)
    return _streamed_job(spark, sf, Window("w", "sum", "global", "count"), trigger, "job_punctuation", "update").select("event_type", "fire_seq", "state")


@query("SELECT event_type, CAST(count(*) * 2 AS VARCHAR) AS state, max(event_id) AS fire_seq FROM events GROUP BY event_type HAVING count(*) % 2 = 0 UNION ALL SELECT event_type, CAST((count(*) - 1) * 2 AS VARCHAR), max(event_id) FILTER (WHERE last > 1) FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS last FROM events) GROUP BY event_type HAVING count(*) % 2 = 1")
def stream_job_custom(spark, sf):
    """A custom trigger that fires at every second segment of a group: the last release of each, twice its count."""
    second = Trigger("g", "w", CustomTrigger(0, lambda t, state, event: state + 1, lambda t, state, event, extent: event["type"] == "new-segment" and state % 2 == 0), emit=lambda df: df)
    out = _streamed_job(spark, sf, Window("w", "sum", "global", "count"), second, "job_custom", "update")
    return out.groupBy("event_type").agg(F.max_by("state", "fire_seq").alias("state"), F.max("fire_seq").alias("fire_seq")).withColumn("state", (F.col("state").cast("long") * 2).cast("string"))


@query(f"SELECT * FROM ({_fixed_sql('CAST(count(*) AS BIGINT) AS state')}) WHERE upper_ms < (SELECT max(epoch_us(ts) // 1000) FROM events)")
def stream_job_watermark(spark, sf):
    """Extents that the watermark has passed, each once; the last day is still open."""
    trigger = Trigger("g", "w", "watermark", state_context=("window-state",), post_evictor="all", emit=lambda df: df)
    return _streamed_job(spark, sf, Window("w", "sum", "fixed", "count", window_key="ts", range=DAY), trigger, "job_watermark", "append")

"""Two-level running aggregates, folds over sorted tasks and joins by window, against plain Python."""

import pytest
from pyspark.sql import functions as F

from millrace.model import Trigger, Window
from millrace.operators import patterns, sorted as own
from millrace.operators.aggregations import Aggregation
from millrace.operators.triggers import replay, replay_fold
from millrace.operators.windows import aggregate
from millrace.validate import InvalidJob, validate

ROWS = [(i, None if i % 7 == 0 else "ab"[i % 3 == 0], None if i % 5 == 0 else (i * 13) % 31) for i in range(60)]
DDL = "seq long, g string, v long"


@pytest.fixture(autouse=True)
def short(monkeypatch):
    monkeypatch.setattr(own, "STRETCH", 3)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running_over_stretches(spark, keys):
    states = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = {(r.seq, r.n, r.s, r.lo, r.hi) for r in own.running(spark.createDataFrame(ROWS, DDL), keys, "seq", states).collect()}
    want, seen = set(), {}
    for seq, g, v in ROWS:
        past = seen.setdefault(g if keys else None, [])
        past.append(v)
        there = [x for x in past if x is not None]
        want.add((seq, len(past), sum(there) if there else None, min(there, default=None), max(there, default=None)))
    assert got == want


def test_running_of_an_empty_table(spark):
    assert own.running(spark.createDataFrame([], DDL), ["g"], "seq", {"n": ("sum", F.lit(1))}).collect() == []


LIST = dict(create=lambda s: [s["seq"]], apply=lambda a, b: a + b, init=list, schema="array<long>")


@pytest.mark.parametrize("merge", [None, lambda a, b: a + b])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_users_aggregation_keeps_the_order(spark, merge, groups):
    df = spark.createDataFrame(ROWS, DDL).repartition(5)
    out = aggregate(df, Window("w", "t", "global", Aggregation(**LIST, merge=merge)), groups, ["seq"]).collect()
    want = {}
    for seq, g, _ in ROWS:
        want.setdefault(g if groups else None, []).append(seq)
    assert {(r["g"] if groups else None): r.state for r in out} == want


@pytest.mark.parametrize("evictor", ["none", "all"])
@pytest.mark.parametrize("every", [False, True])
def test_replay_by_fold_equals_replay_by_windows(spark, evictor, every):
    trigger = Trigger("g", "w", "segment", threshold=(4, "elements"), fire_all_extents=every, post_evictor=evictor)
    window = Window("w", "t", "sliding", "count", window_key="seq", range=(10, "elements"), slide=(5, "elements"))
    rows = lambda df: sorted((r.g or "", r.fire_seq if r.fire_seq is not None else -1, r.lower_ms, r.upper_ms, int(r.state)) for r in df.collect())
    df = spark.createDataFrame(ROWS, DDL)
    assert rows(replay_fold(df, window, trigger, ["g"], "seq", True)) == rows(replay(df, window, trigger, ["g"], "seq", True))


@pytest.mark.parametrize("window", [Window("w", "t", "global", "count"), Window("w", "t", "sliding", "count", window_key="t", range=(6, "elements"), slide=(3, "elements")), Window("w", "t", "session", "count", window_key="t", timeout_gap=(2, "elements"))], ids=["global", "sliding", "session"])
def test_windowed_join(spark, window):
    a, b = [(1, t, f"a{t}") for t in (0, 4, 5, 20)], [(1, t, f"b{t}") for t in (2, 9, 21)] + [(2, 0, "b")]
    got = patterns.windowed_join(spark.createDataFrame(a, "k long, t long, x string"), spark.createDataFrame(b, "k long, t long, y string"), ["k"], window).collect()
    if window.type == "global":
        want = [(x, y, None) for _, _, x in a for k, _, y in b if k == 1]
    elif window.type == "session":
        want = [(x, "b2", 0) for x in ("a0", "a4", "a5")] + [("a20", "b21", 20)]
    else:
        at = lambda t: set(range(t // 3, (t + 6) // 3))
        want = [(x, y, max(0, 3 * (w + 1) - 6)) for _, t, x in a for k, u, y in b if k == 1 for w in at(t) & at(u)]
    assert sorted((r.x, r.y, r.lower_ms) for r in got) == sorted(want)


def test_resume_points_name_one_job():
    from test_jobs import numbers

    from millrace.model import Job

    with pytest.raises(InvalidJob, match="needs the job-id"):
        validate(Job(*numbers(3), resume_point={"in": {"mode": "resume"}}))
    with pytest.raises(InvalidJob, match="kept together"):
        validate(Job(*numbers(3), windows=[Window("w", "add", "global", "count")], resume_point={"in": {"mode": "resume", "job-id": "a"}, "w": {"mode": "initialize"}}))

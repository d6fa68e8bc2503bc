"""Window aggregations as Columns, and user-defined ones as folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Aggregation:
    """A user's aggregation: state = apply(state, create(segment)), from init() on; merge joins the states of two
    extents that become one. schema: DDL type of the state."""

    create: Callable[[dict], Any]
    apply: Callable[[Any, Any], Any]
    schema: str
    init: Callable[[], Any] | None = None
    merge: Callable[[Any, Any], Any] | None = None


def _as_is(c: Column) -> Column:
    return c


def _ordered(value: Column, seq: Sequence[str], own: Callable[[Column], Column]) -> Column:
    """Values in the order of arrival, as far as seq tells it."""
    if not seq:
        return own(F.collect_list(value))
    got = F.array_sort(own(F.collect_list(F.struct(*seq, value.alias("__v")))))
    return F.transform(got, lambda x: x["__v"])


AGGREGATIONS = ("conj", "collect-by-key", "collect-key-value", "sum", "count", "min", "max", "average", "set-value")


def columns_of(aggregation, init, columns: Sequence[str], seq: Sequence[str], own: Callable[[Column], Column] = _as_is) -> dict[str, Column]:
    """State columns of a built-in aggregation (but collect-by-key, which groups twice; see windows.aggregate), for
    groupBy().agg(). Running states give `own`, which puts each aggregate over a window."""
    name, key = (aggregation, None) if isinstance(aggregation, str) else aggregation
    if name == "conj":
        return {"state": _ordered(F.struct(*columns), seq, own)}
    if name == "collect-key-value":
        return {"state": _ordered(F.col(key), seq, own)}
    if name == "set-value":
        return {"state": own(F.max_by(key, F.struct(*seq)) if seq else F.last(key))}
    if name == "count":
        return {"state": own(F.count(F.lit(1)))}
    if name == "min":
        return {"state": F.least(F.lit(init), own(F.min(key)))}
    if name == "max":
        return {"state": F.greatest(F.lit(init), own(F.max(key)))}
    total = F.coalesce(own(F.sum(key)), F.lit(0))
    if name == "sum":
        return {"state": total}
    return {"n": own(F.count(key)), "sum": total, "average": own(F.sum(key)) / own(F.count(key))}


def fold_of(aggregation, init) -> Aggregation:
    """The same aggregations as Python folds over dicts, for stateful streaming."""
    if isinstance(aggregation, Aggregation):
        return aggregation
    name, key = (aggregation, None) if isinstance(aggregation, str) else aggregation
    get = lambda s: s[key]
    if name == "count":
        return Aggregation(lambda s: 1, lambda a, b: a + b, "long", lambda: 0, lambda a, b: a + b)
    if name == "sum":
        return Aggregation(get, lambda a, b: a if b is None else a + b, "double", lambda: 0, lambda a, b: a + b)
    if name in ("min", "max"):
        pick = min if name == "min" else max
        return Aggregation(get, lambda a, b: a if b is None else pick(a, b), "double", lambda: init, pick)
    if name == "average":
        add = lambda a, b: {"n": a["n"] + b["n"], "sum": a["sum"] + b["sum"], "average": (a["sum"] + b["sum"]) / max(a["n"] + b["n"], 1)}
        return Aggregation(lambda s: {"n": int(s[key] is not None), "sum": s[key] or 0}, add, "struct<n:long,sum:double,average:double>", lambda: {"n": 0, "sum": 0}, add)
    if name == "set-value":
        return Aggregation(get, lambda a, b: b, "string", lambda: None, lambda a, b: b)
    if name == "collect-by-key":
        add_to = lambda a, b: a | {b[0]: a.get(b[0], []) + [x for x in b[1] if x not in a.get(b[0], [])]}

        def union(a, b):
            for item in b.items():
                a = add_to(a, item)
            return a

        return Aggregation(lambda s: (s[key], [s]), add_to, "string", dict, union)
    return Aggregation(dict if name == "conj" else get, lambda a, b: [*a, b], "string", list, lambda a, b: [*a, *b])

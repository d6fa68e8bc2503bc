"""Registered functions: jobs may name functions instead of holding them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable] = {}


def register(name: str):
    def keep(fn: Callable) -> Callable:
        REGISTRY[name] = fn
        return fn

    return keep


def resolve(fn):
    """A callable, or what is registered by a name."""
    if fn is None or callable(fn):
        return fn
    if fn not in REGISTRY:
        raise KeyError(f"no function is registered as {fn!r}")
    return REGISTRY[fn]


def to_ms(c: Column) -> Column:
    """A timestamp as milliseconds since 1970."""
    return F.unix_millis(c.cast("timestamp"))


def java_function(spark, name: str, class_name: str, return_type=None) -> str:
    """Registers a Java UDF by its class, for use in SQL expressions; returns the name."""
    spark.udf.registerJavaFunction(name, class_name, return_type)
    return name

"""Ready-made tasks, as used again and again in catalogs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from millrace import sources
from millrace.model import Task


def literal(name: str, rows: Sequence[Any], schema: str, **more: Any) -> Task:
    """An input of literal rows."""
    return Task(name, "input", source=sources.seq(rows, schema), **more)


def made(name: str, make: Callable[[], Sequence[Any]], schema: str, **more: Any) -> Task:
    """An input of rows that a function makes when the job starts."""
    return Task(name, "input", source=sources.materialized(make, schema), **more)


def text(name: str, path: str, **more: Any) -> Task:
    """An input of a text file's lines."""
    return Task(name, "input", source=sources.text_file(path), **more)


def channel_in(name: str, folder: str, schema: Any, **more: Any) -> Task:
    """An input that streams the Parquet files that come into a folder."""
    return Task(name, "input", source=sources.stream_files(folder, schema, max_files=more.pop("max_files", None)), **more)


def channel_out(name: str, folder: str, **more: Any) -> Task:
    """An output that puts its batches into a folder, from which channel_in() of another job may read."""
    return Task(name, "output", sink=sources.to_files(folder), **more)


def function(name: str, fn: Callable, **more: Any) -> Task:
    return Task(name, "function", fn=fn, **more)


def null(name: str, **more: Any) -> Task:
    """An output that keeps nothing."""
    return Task(name, "output", sink=sources.discard(), **more)


def effect(name: str, fn: Callable[[Any], None], **more: Any) -> Task:
    """An output that calls fn with each row; an error fails the job."""
    return Task(name, "output", sink=sources.each(fn), **more)

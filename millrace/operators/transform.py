"""Task functions: DataFrame functions stay in Catalyst; Python functions of segments run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What a failed call is told in: kind of the exception and its message; null where the call went well.
ERROR = "_error"
OLD = "_old"
_ERROR_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())])


def flat(made: Any) -> list[dict]:
    """A function's result as segments: a dict is one, a list many, an empty list none."""
    return [made] if isinstance(made, dict) else list(made or ())


def as_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(ddl)


def segments(df: DataFrame, fn: Callable, params: Sequence[Any], schema: str, batch_fn: bool = False, batch_size: int = 1000, capture: bool = False, keep_old: bool = False) -> DataFrame:
    """fn over rows as dicts. capture: a call that raises gives one row with only ERROR set, instead of failing the
    job. keep_old: the input row beside the output, in OLD. A batch fn gets up to batch_size rows and must return as
    many results, each a dict or a list."""
    out_type = T.StructType.fromDDL(schema)
    full = T.StructType([*out_type.fields, *([T.StructField(ERROR, _ERROR_TYPE)] if capture else []), *([T.StructField(OLD, df.schema)] if keep_old else [])])
    arrow = to_arrow_schema(full)

    def failed(e: Exception) -> list[dict]:
        return [{ERROR: {"type": type(e).__name__, "message": str(e)}}]

    def one(row: dict) -> list[dict]:
        try:
            return flat(fn(*params, row))
        except Exception as e:
            if not capture:
                raise
            return failed(e)

    def many(rows: list[dict]) -> list[list[dict]]:
        try:
            made = list(fn(*params, rows))
        except Exception as e:
            if not capture:
                raise
            return [failed(e) for _ in rows]
        if len(made) != len(rows):
            raise ValueError(f"a batch fn must return as many results as it gets segments: {len(rows)} in, {len(made)} out")
        return [flat(m) for m in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                rows = batch.slice(at, batch_size).to_pylist()
                made = many(rows) if batch_fn else [one(r) for r in rows]
                out = [m | {OLD: r} if keep_old else m for r, leaves in zip(rows, made, strict=True) for m in leaves]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, full)

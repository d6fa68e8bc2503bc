"""Sources and sinks. A source is called with the session and returns a DataFrame, static or streaming; a sink is
called with a DataFrame. Python classes of Spark's own data source interface plug in by format()."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def seq(rows: Sequence[Any], schema: str) -> Callable[[SparkSession], DataFrame]:
    """Literal rows."""
    return lambda spark: spark.createDataFrame(list(rows), schema)


def materialized(make: Callable[[], Sequence[Any]], schema: str) -> Callable[[SparkSession], DataFrame]:
    """Rows that a function makes when the job starts."""
    return lambda spark: spark.createDataFrame(list(make()), schema)


def text_file(path: str) -> Callable[[SparkSession], DataFrame]:
    """One segment for each line, in the field line. Lines end with a line feed."""
    return lambda spark: spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def files(path: str, format: str = "parquet", **options: Any) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.read.format(format).options(**options).load(path)


def stream_files(path: str, schema, format: str = "parquet", max_files: int | None = None, **options: Any) -> Callable[[SparkSession], DataFrame]:
    """A stream of the files that come into a folder; max_files for each micro-batch holds back pressure."""
    options |= {"maxFilesPerTrigger": max_files} if max_files else {}
    return lambda spark: spark.readStream.format(format).schema(schema).options(**options).load(path)


def table(name: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.table(name)


def frame(df: DataFrame) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: df


def plugin(data_source: type, **options: Any) -> Callable[[SparkSession], DataFrame]:
    """A class of pyspark.sql.datasource.DataSource."""

    def read(spark: SparkSession) -> DataFrame:
        spark.dataSource.register(data_source)
        return spark.read.format(data_source.name()).options(**options).load()

    return read


def to_memory(name: str) -> Callable[[DataFrame], None]:
    """A temporary view by which results are looked up."""
    return lambda df: df.createOrReplaceTempView(name)


def to_files(path: str, format: str = "parquet", mode: str = "append", partition_by: Sequence[str] = ()) -> Callable[[DataFrame], None]:
    return lambda df: df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def discard() -> Callable[[DataFrame], None]:
    """Runs everything and keeps nothing."""
    return lambda df: df.write.format("noop").mode("append").save()


def each(fn: Callable[[Any], None]) -> Callable[[DataFrame], None]:
    """fn on every row, on the executors, for its effect; an error fails the job."""
    return lambda df: df.foreach(fn)


def each_batch(fn: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    return fn

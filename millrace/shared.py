"""The folder that driver and executors share, in which the engine keeps results of streams and jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, under one of our own on a single machine; on a cluster
    each executor would write to its own disk, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/millrace"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(path)
    return at, at.getFileSystem(conf), conf


def exists(spark: SparkSession, path: str) -> bool:
    at, fs, _ = _at(spark, path)
    return fs.exists(at)


def copy(spark: SparkSession, source: str, target: str) -> None:
    (a, from_, conf), (b, to, _) = _at(spark, source), _at(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, False, conf)


def delete(spark: SparkSession, path: str) -> None:
    at, fs, _ = _at(spark, path)
    fs.delete(at, True)

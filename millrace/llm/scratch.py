"""Tables written to the cluster's shared folder, and helpers used by all operators."""

from __future__ import annotations

import re
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
SPACE = "\t\n\x0b\x0c\r "
#: Spark's setting that deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own on a single machine; executors of
    a cluster would each write to their own disk, so there it is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/millrace"


class Scratch:
    """Cuts lineage: keep() writes a DataFrame as Parquet to the shared folder and reads it back.

    A lost executor then costs at most the stage that was running. Shuffle files that led to a table are
    deleted as soon as it is written. Tables are compressed with zstd, as they hold whole texts. drop() removes a table that no
    later step reads. Tables that a returned DataFrame still reads stay until the cluster cleans
    its checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def process_cache() -> types.ModuleType:
    """A place that lives as long as the Python worker, for tokenizers and the like."""
    return sys.modules.setdefault("_millrace_cache", types.ModuleType("_millrace_cache"))

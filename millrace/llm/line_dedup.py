"""Exact line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import SPACE, Scratch, ascii_lower


def _keys(text, min_chars: int):
    """Array of (pos, h) of a text's lines that are long enough to count."""
    keyed = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), ascii_lower(F.btrim(x, F.lit(SPACE))).alias("key")))
    long = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(x["key"])).alias("h")))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, text_col with repeated lines removed, plus n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of
    at least min_chars code points that at least min_docs documents hold loses all its lines except
    in the largest id that holds it. Other lines stay, joined by newlines.

    Null or empty text: one empty line. Null id: the row passes unchanged and counts towards no key.
    Rows that share an id are one document for the count; each row is cleaned by its own lines, and
    repeated rows alike. Very long texts are split once, so the work is in proportion to their lines.
    Empty table: no rows. Columns named n_lines or n_dropped are replaced.

    Only 16-byte hashes of lines are dealt by key; counts are summed before they are shuffled, and
    the join back to the lines is a plain one that Spark splits where a line is very common. The text
    moves once, to meet its dropped positions, at any size: these grow with the documents, so they
    are never broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("n_lines", "n_dropped")
    kept = scratch.keep(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), _keys(text, min_chars).alias("k")).where(F.size("k") > 0))
    lines = kept.select("id", "t", F.inline("k"))
    shared = lines.select("h", "id").groupBy("h").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("h", "keep")
    shared = scratch.keep(shared)
    gone = lines.join(shared, "h").where("id < keep").groupBy("id", "t").agg(F.collect_set("pos").alias("__gone"))
    gone = scratch.keep(gone)
    scratch.drop(kept, shared)
    gone = gone.select(F.col("id").alias("__id"), F.col("t").alias("__t"), "__gone")
    out = docs.withColumn("__h", F.xxhash64(text)).join(gone.hint("merge"), (F.col(id_col) == F.col("__id")) & (F.col("__h") == F.col("__t")), "left")
    split = F.split(text, "\n", -1)
    # A variable of a function is worked out once; a column in it would be split anew for each line.
    stay = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__gone"))
    rest = F.transform(F.array(split), lambda own: F.array_join(F.transform(stay(own), lambda i: F.get(own, i)), "\n"))
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    cleaned = F.when(F.col("__gone").isNull(), text).otherwise(F.get(rest, 0))
    keep = [F.col(c) if c != text_col else cleaned.alias(text_col) for c in docs.columns]
    return out.select(*keep, F.size(split).cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(n_gone).cast("long").alias("n_dropped"))

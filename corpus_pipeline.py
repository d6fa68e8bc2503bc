"""From raw documents to packed training sequences, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mixing, packing, shingle_pairs, toxicity
from millrace.llm.queries import ENTROPY, REPEATS, TOXIC, vocabulary
from millrace.llm.scratch import Scratch


def _beside(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame], **changed: str) -> DataFrame:
    """stage(docs) with the columns of docs alone, those named as what the stage adds included. changed: columns of docs
    that follow the text, as SQL."""
    hidden = {c: f"__own_{c}" for c in docs.columns if c in added}
    out = stage(docs.withColumnsRenamed(hidden))
    return out.select(*(F.expr(changed[c]).alias(c) if c in changed else F.col(hidden.get(c, c)).alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half, by a chain fitted on the labelled ones.

    Null and empty texts have no words and stay if the labels say that most are clean. Null ids are judged like others, and
    never trained on. Repeated rows are judged alike. Very long texts are judged whole. Empty table: no rows. Other columns,
    whatever their names, stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _beside(docs, ("p_quality", "p_toxic"), lambda d: toxicity.with_toxicity(d, labels).where(F.col("p_toxic") < TOXIC))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; n_chars, where there is one, follows the text.

    Every row stays, also those left without text. Null and empty texts become empty. Null ids pass unchanged. Rows
    that repeat an id are one document for the count. Very long texts are taken whole. Empty table: no rows. Other columns,
    whatever their names, stay as they are.
    """
    return _beside(docs, ("n_lines", "n_dropped"), line_dedup.dedup_lines, n_chars="cast(char_length(text) as bigint)")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that with the smallest id.

    Texts without words, null ones among them, are alike, so one of them stays. Null ids stay. Rows that repeat an id are one
    document and stay or go together. Very long texts are compared whole. Empty table: no rows. Other columns, whatever
    their names, stay as they are.
    """
    return shingle_pairs.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for.

    A null source is a source. Sources without words pass once. Null ids and repeated rows are documents like others.
    A very long text counts by its words; one that has more than its source may use is left out. Empty table: no rows. Other
    columns, whatever their names, stay as they are.
    """
    return _beside(docs, ("mix_weight", "mix_pass", "mix_key"), lambda d: mixing.mix(d, ENTROPY, REPEATS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens.

    Null and empty texts are the end id alone. Null ids and repeated rows are packed like others. Very long texts are cut
    into full pieces. Empty table: no rows. Other columns are left behind.
    """
    return packing.best_fit_packing(docs, vocabulary())


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("mixing", mix_sources), ("best_fit_packing", pack)]
#: Not expressible: trained models, XXH64 and tokenizers. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs)
            scratch.drop(before)
    return docs

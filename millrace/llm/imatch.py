"""I-Match fingerprints: hashes of a document's terms within a band of inverse document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, partitions
from millrace.llm.toxicity import words

#: Randomised lexicons: each of SEEDS draws one of every share of the band's terms, 1/2, 1/4 and so on to 2^-SHARES.
SEEDS, SHARES = 6, 11
#: Hex digits of each lexicon's hash in a fingerprint.
DIGITS = 4
LEXICONS = SEEDS * SHARES
#: The band: terms in at most this share of documents, and that make up at least one in LARGEST of all
#: (document, term) pairs. Both are shares, so the band does not move as a corpus of the same kind grows, and
#: at most LARGEST terms can be in it.
MOST, LARGEST = 0.05, 1_000_000
_SEEDS = np.random.default_rng(2004).integers(0, 2**64, SEEDS, dtype=np.uint64)
_EMPTY = "0" * DIGITS
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def term_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct terms."""
    from xxhash import xxh64_intdigest

    found = words(text)
    return np.unique(np.fromiter(map(xxh64_intdigest, found), dtype=np.uint64, count=len(found)))


def lexicon(docs: DataFrame, most: float = MOST, largest: int = LARGEST, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms within the band, counted over all documents; at most `largest`.

    A term is in the band if it is in 2 documents at least, in pairs / largest at least (pairs: distinct
    terms of all documents, summed) and in `most` of the documents at most (2 in a small corpus).
    Null and empty texts are documents without terms; repeated rows count each; very long texts count whole. Empty
    table: an empty band. Other columns are not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs_seen = [], 0, 0

        def flush() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64))], names=["term", "df", "docs"])

        for batch in batches:
            for text in batch.column(0):
                held.append(term_hashes(text.as_py()))
                size += len(held[-1])
                docs_seen += 1
                if size > 1_000_000:
                    yield flush()
                    size = 0
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([docs_seen], pa.int64())], names=["term", "df", "docs"])

    scratch = Scratch(docs.sparkSession, "imatch-df")
    terms = docs.select(F.col(text_col)).mapInArrow(count, "term long, df long, docs long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs"))
    terms = scratch.keep(terms.where("term is null or df > 1"))
    pairs, n = terms.agg(F.sum("df"), F.sum("docs")).first()
    least = max(2, -(-(pairs or 0) // largest))
    band = terms.where((F.col("df") >= least) & (F.col("df") <= max(2, int(most * (n or 0)))) & F.col("term").isNotNull())
    got = np.sort(band.select("term").toArrow()["term"].to_numpy().view(np.uint64))
    scratch.drop(terms)
    return got


def lexicon_hashes(terms: np.ndarray) -> str:
    """DIGITS hex digits for each randomised lexicon: the hash of its terms among the given ones (sorted,
    distinct), all zeros where it has none of them.

    A lexicon was drawn before any text was seen: that of seed j and share 2^-k has the terms whose
    mix with the seed is below 2^(64-k).
    """
    from xxhash import xxh64_intdigest

    out = []
    for seed in _SEEDS:
        drawn = _mix(terms ^ seed)
        for k in range(1, SHARES + 1):
            own = terms[drawn < np.uint64(1 << (64 - k))]
            if not len(own):
                out += [_EMPTY] * (SHARES + 1 - k)
                break
            out.append(f"{xxh64_intdigest(own.tobytes(), k) % (16**DIGITS - 1) + 1:0{DIGITS}x}")
    return "".join(out)


def fingerprint(text: str | None, band: np.ndarray) -> str:
    """16 hex digits of the hash of the text's distinct terms in the band, sorted, and DIGITS for each randomised
    lexicon. A text without terms in the band has no lexicon's terms, and its 16 digits are those of the text itself."""
    from xxhash import xxh64_hexdigest

    terms = term_hashes(text)
    if len(band) and len(terms):
        terms = terms[band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms]
    if not len(band) or not len(terms):
        return xxh64_hexdigest((text or "").encode("utf-8", "surrogatepass")) + _EMPTY * LEXICONS
    return xxh64_hexdigest(terms.tobytes()) + lexicon_hashes(terms)


def likeness(a: str, b: str) -> float:
    """1 if the hashes of all terms agree, else the share of lexicons that agree, of those that have terms of either."""
    if a[:16] == b[:16]:
        return 1.0
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(16, 16 + DIGITS * LEXICONS, DIGITS)]
    told = [x == y for x, y in pairs if x != _EMPTY or y != _EMPTY]
    return sum(told) / len(told) if told else 0.0


def with_fingerprint(docs: DataFrame, band: np.ndarray, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the I-Match fingerprint of text_col in the column `out`, which is replaced if it is there.

    Null text: empty. Equal texts have equal fingerprints. Very long texts are taken whole. Empty table: no rows."""
    import pandas as pd

    shared = docs.sparkSession.sparkContext.broadcast(band)  # at most LARGEST numbers

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shared.value) for t in texts], dtype=object)

    return docs.withColumn(out, of(F.col(text_col)))


def edited_likeness(docs: DataFrame, band: np.ndarray, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its text edited with the next document's beginning, and
    the likeness of its own to both. The next document is that with the next larger id; after the last comes the first.

    Null text: empty. Null ids come first. Rows that repeat an id follow one another by the hash of their text, and each is a
    document. One row is its own next. Very long texts are taken whole. Empty table: no rows. Other columns, whatever
    their names, are left behind.

    Rows are dealt by ranges of ids, and of text hashes and row numbers within an id, so that no id makes a task too large. A
    task pairs its rows as they come, sorted, and hands on its first and last; each last is joined to
    the first of the next task that has rows, two texts at a time.
    """
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(band)
    names = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    shape = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"

    def result(now: tuple, after: tuple) -> tuple:
        id_, text, own = now
        n = len(text)
        edited = text[: n - n // 4] + after[1][: n // 4]
        other = fingerprint(edited, shared.value)
        return (0, 0, id_, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, after[2]), None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                after = (id_, text, fingerprint(text, shared.value))
                rows.append((1, part, id_, None, None, after[2], None, None, None, text) if now is None else result(now, after))
                now = after
                if len(rows) >= 500:
                    yield batch_of(rows)
                    rows = []
        if now is not None:
            rows.append((2, part, now[0], None, None, now[2], None, None, None, now[1]))
        yield batch_of(rows)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield batch_of([result((r["doc_id"], r["text"], r["fingerprint"]), (None, r["next_text"], r["next_fingerprint"]))])

    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    dealt = own.repartitionByRange(n, "id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "text")
    out = scratch.keep(dealt.mapInArrow(pair, shape))
    parts = sorted(r.part for r in out.where("kind = 1").select("part").collect())  # numbers of tasks
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    firsts = out.where("kind = 1").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"), F.col("text").alias("next_text"))
    lasts = out.where("kind = 2").select("part", "doc_id", "fingerprint", "text").join(following, "part").join(firsts, "next_part")
    ends = lasts.repartition(n, "part").mapInArrow(close, shape)
    return out.where("kind = 0").union(ends).drop("kind", "part", "text")

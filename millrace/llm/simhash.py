"""SimHash near-dedup: links by pivot distance tables inside blocks that share bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import Scratch

#: Reference fingerprints whose Hamming distances make a fingerprint's row of the table.
PIVOTS = np.random.default_rng(20130417).integers(0, 2**64, 24, dtype=np.uint64)
#: Fingerprints of a bucket that are compared with one another; larger ones are split by their distances to so many pivots.
BLOCK, SPLIT = 1024, 4
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of so many words, A-Z lower-cased; of all words where they are fewer."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not found:
        return []
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), 42)]
    line = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    begins = [0, *(ends[:-words]).tolist()]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)]


def simhash(text: str | None, words: int = 3) -> int:
    """64 bits, each set where it is set in over half of the shingles' hashes; no words: 0."""
    return fingerprint(np.array(shingle_hashes(text, words), dtype="<u8"))


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of hashes (little-endian, repeats included); of none: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words: int = 3, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs with the SimHash of text_col as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text_col)))


def block_pairs(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs at Hamming distance of at most `most`.

    Distances to the pivots obey the triangle inequality: two fingerprints within `most` bits differ
    by at most `most` in every coordinate. The rows are sorted by the first coordinate, compared with
    the rows whose first coordinate is near, and only pairs near in all coordinates are verified.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left, right = [], []
    for i in range(0, len(fps), 128):
        own = table[i : i + 128]
        end = int(np.searchsorted(table[:, 0], own[-1, 0] + most, "right"))
        near = np.ones((len(own), end - i), dtype=bool)
        for k in range(table.shape[1]):
            near &= np.abs(own[:, k, None] - table[None, i:end, k]) <= most
        a, b = np.nonzero(np.triu(near, 1))
        good = np.bitwise_count(fps[i + a] ^ fps[i + b]) <= most
        left.append(order[i + a[good]])
        right.append(order[i + b[good]])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _link_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(c, k, fp, rep):
            out_a, out_b = [], []
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(c)], strict=True):
                if j - i == 2:
                    if int(fp[i] ^ fp[i + 1]).bit_count() <= most:
                        out_a.append(rep[i : i + 1])
                        out_b.append(rep[i + 1 : j])
                elif j - i > 2:
                    order = np.argsort(rep[i:j])
                    f, r = fp[i:j][order], rep[i:j][order]
                    tree = _forest(j - i, *block_pairs(f, most))
                    moved = tree != np.arange(j - i)
                    out_a.append(r[moved])
                    out_b.append(r[tree[moved]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            part[2] = part[2].view(np.uint64)
            if held:
                part = [np.concatenate(x) for x in zip(held[0], part, strict=True)]
            last = int(np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))[-1]) + 1 if len(part[0]) and ((part[0] != part[0][-1]) | (part[1] != part[1][-1])).any() else 0
            yield from links(*(x[:last] for x in part)) if last else ()
            held = [tuple(x[last:] for x in part)]
        if held and len(held[0][0]):
            yield from links(*held[0])

    return run


def link_fingerprints(fps: DataFrame, scratch: Scratch, most: int = 2) -> DataFrame:
    """fps: distinct (fp, rep), longs. Returns links (a, b) between reps that join exactly the
    fingerprints that a chain of steps of at most `most` differing bits joins.

    64 bits in `most` + 2 blocks: two fingerprints that near agree on two whole blocks, so each goes to
    one bucket for each pair of blocks. Buckets of up to BLOCK fingerprints are linked by a pivot
    distance table. A larger one is first split by its first SPLIT coordinates in that table: ranges of
    `most` + 1 distances, where a fingerprint also goes to the range that `most` more would reach, so
    that near ones meet in some range of all coordinates. A ball of fingerprints around one centre can still
    fill a range, at like distances to any pivot; those are dealt to themselves and to the 64 fingerprints one bit
    away, and what meets there, 65 at most, is within two bits.
    """
    if most > 2:
        raise ValueError("the exact way for large buckets holds for at most 2 differing bits")
    n = most + 2
    edge = [64 * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    masks = [(x | y) - (1 << 64) * ((x | y) >> 63) for x, y in combinations(block, 2)]
    keys = fps.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("c", "k"))
    counts = scratch.keep(keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"))
    small = keys.join(counts.where(F.col("n") <= BLOCK).drop("n"), ["c", "k"])
    small = small.select("c", "k", "fp", "rep").repartition("c", "k").sortWithinPartitions("c", "k")
    links = small.mapInArrow(_link_blocks(most), "a long, b long")
    large = counts.where(F.col("n") > BLOCK).drop("n")
    if large.isEmpty():
        return links
    reach = lambda p: F.array_distinct(F.array(*(F.floor((F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) + x) / (most + 1)) for x in (0, most))))
    cells = keys.join(large, ["c", "k"])
    for i, p in enumerate(PIVOTS[:SPLIT].view(np.int64).tolist()):
        cells = cells.withColumn(f"p{i}", F.explode(reach(p)))
    at = [f"p{i}" for i in range(SPLIT)]
    cells = scratch.keep(cells.select("c", F.xxhash64("k", *at).alias("k"), "fp", "rep"))
    full = scratch.keep(cells.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"))
    some = cells.join(full.where(F.col("n") <= BLOCK).drop("n"), ["c", "k"])
    links = links.union(some.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_link_blocks(most), "a long, b long"))
    full = full.where(F.col("n") > BLOCK).drop("n")
    if full.isEmpty():
        return links
    crowd = cells.join(full, ["c", "k"]).select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)) for i in range(64)))
    dealt = crowd.select("rep", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("z"))
    met = dealt.groupBy("z").agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all")).where(F.size("all") > 1)
    return links.union(met.select(F.explode("all").alias("a"), "b").where("a != b"))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, fp (signed long) and component_id, the smallest id that
    can be reached over links of at most `most` differing bits, its own included.

    Texts are taken whole, A-Z lower-cased, in shingles of so many words, repeats included; fewer
    words make one shingle, and none (or a null text) the fingerprint 0, linked like any other. Rows
    with a null id get a null component unless they share a fingerprint with others; they are never
    a representative. Repeated rows give repeated results. Very long texts are taken whole. Empty table: no rows.
    Only id_col is returned of docs' columns, so none can clash with fp or component_id.

    Equal fingerprints are one node, so groups of copies of any size cost one row in the links.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = scratch.keep(with_fingerprint(own, words).select("id", "fp"))
    fps = scratch.keep(own.groupBy("fp").agg(F.min("id").alias("rep")))
    links = link_fingerprints(fps.where("rep is not null"), scratch, most)
    of = connected_components(links, scratch)
    named = scratch.keep(fps.join(of, fps.rep == of.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest. Rows with a null id stay; rows that
    repeat an id are one document and stay or go together."""
    marked = near_duplicates(docs, words, most, id_col, text_col)
    gone = marked.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)

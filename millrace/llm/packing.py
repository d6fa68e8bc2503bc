"""Best-fit packing of tokenized documents, planned from the counts of their sizes."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, process_cache

#: Pieces that are numbered together.
ITEMS = 50_000
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(tokens' bytes -> ids, added strings -> ids) of a byte-level BPE .json file. Each byte is written there as one
    printable character: those that are printable as themselves, the others, in order, from U+0100 on."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    added = made["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or made["normalizer"] or made["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in added}
    return {bytes(byte_of[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in special}, special


def byte_bpe(vocabulary: str) -> Callable[[str], list[int]]:
    """text -> the ids that the tokenizers library gives by this .json file without special tokens of its own; strings
    of the file's added tokens are those tokens. Encoded by tiktoken, which takes a quarter of the time: ids
    grow with the order of merges, so they are its ranks."""
    cache = process_cache().__dict__.setdefault("bpe", {})
    if vocabulary not in cache:
        import tiktoken
        from public_tokenizers import PATTERN

        ranks, special = _vocabulary(vocabulary)
        cache[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: cache[vocabulary].encode(text, allowed_special="all")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), start, length, ids_crc32.

    A document is the ids of its text and then the id `end`. One longer than `capacity` is cut so
    that all pieces but the first are full; the first takes what remains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    for col, v in zip(out, (id_, k, at, n, zlib.crc32(ids[at : at + n].tobytes())), strict=True):
                        col.append(v)
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _MEMBER, strict=True)], names=[t.name for t in _MEMBER])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, best fit in decreasing size. Open bins are kept by their room, and the
    rooms in use as bits of one integer, so that an item finds its bin in constant time."""
    bins: list[list[int]] = []
    open_, rooms = defaultdict(list), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - size:
            open_[left].append(b)
            rooms |= 1 << left
    return bins


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit in decreasing size of so many items of each size, by runs of like bins. Rows (size, rank, base, fill, bin):
    items of a size from this rank on go `fill` to a bin, from offset `base`, into bins numbered on from `bin`.

    An item goes to the fullest bin that holds it, which is then still the fullest for the next of its size, so each bin takes all that
    fit. A size splits one run at most and opens two, so runs are bounded by the sizes, however many items there are.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, opened = [], 0
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=capacity)
            fill = min(room // size, left)
            take = left // fill
            if open_.get(room):
                first, n = open_[room].pop()
                take = min(take, n)
                if n > take:
                    open_[room].append((first + take, n - take))
            else:
                first, opened = opened, opened + take
            if not open_[room]:
                del open_[room]
            rows.append((size, rank, capacity - room, fill, first))
            rank, left = rank + take * fill, left - take * fill
            if rest := room - fill * size:
                open_[rest].append((first, take))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _numbered(per_task: int):
    """Adds to each piece its block, of at most per_task pieces of a task, and its place among those of its size there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen = TaskContext.get().partitionId(), 0, defaultdict(int)
        for batch in batches:
            blocks, nth = [], []
            for size in batch.column(batch.schema.get_field_index("length")).to_pylist():
                if at % per_task == 0:
                    seen.clear()
                blocks.append(part << 32 | at // per_task)
                nth.append(seen[size])
                seen[size] += 1
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(nth, pa.int64())], names=[*batch.schema.names, "block", "nth"])

    return run


def _placed(rows: np.ndarray):
    """Pieces with their rank among all of their size -> their sequence and offset by the plan."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    size, rank, base, fill, first = rows[order].T
    starts = {int(s): int(i) for i, s in zip(*np.unique(size, return_index=True)[::-1], strict=True)}
    ends = {s: int(np.searchsorted(size, s, "right")) for s in starts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.zeros(len(n), dtype=np.int64)
            for s in np.unique(n).tolist():
                own = n == s
                row[own] = starts[s] + np.searchsorted(rank[starts[s] : ends[s]], r[own], "right") - 1
            into = r - rank[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[row] + into // fill[row]), pa.array(base[row] + into % fill[row] * n)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(items: DataFrame, scratch: Scratch, capacity: int = 1024, per_task: int = ITEMS) -> DataFrame:
    """items: rows of pieces(). Returns them with sequence_id and offset.

    One best fit over all pieces, whatever their number and partitions: sizes are integers, so it is planned from the
    count of each (at most `capacity` rows), and each piece finds its place by its rank among those of its size.
    The rank is its place in its block and the counts of the blocks before.
    """
    schema = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    held = scratch.keep(items.mapInArrow(_numbered(per_task), f"{schema}, block long, nth long"))
    counts = scratch.keep(held.groupBy("length", "block").agg(F.count("*").alias("n")))
    rows = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = held.join(first, ["length", "block"]).select(*items.columns, (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placed(rows), f"{schema}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset; sequences hold at most `capacity` ids without gaps.

    Null or empty text: the end id alone. Null id: packed like any other. Repeated rows: each is
    packed. Empty table: no rows. Ties between sizes go by the order of rows, which changes what shares a sequence
    but not how many there are or how full they are. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(pieces(docs, vocabulary, capacity, end, id_col, text_col), scratch, capacity)

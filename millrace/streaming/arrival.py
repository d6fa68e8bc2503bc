"""A group's segments in the order of arrival, in memory that doesn't grow with the group: sorted runs on disk, merged."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import islice
from operator import itemgetter
from typing import IO

import pandas as pd
import pyarrow as pa

#: Bytes of rows that are sorted at once, and of rows that are read back from a run at once.
RUN, BLOCK = 16 << 20, 1 << 17
#: Runs that are merged at once. Of a level that has as many, one run of the next level is made.
WAYS = 32


def _size(frame: pd.DataFrame) -> int:
    """Bytes of a frame: nested values count as pickled, strings as they lie in memory."""
    return max(int(frame.memory_usage(deep=True).sum()), len(pickle.dumps(frame)))


def _blocks(held: list[pd.DataFrame], seq: str, size: int) -> Iterator[pd.DataFrame]:
    """Frames of size bytes in all as one, sorted, nulls last, and cut in blocks."""
    if held:
        got = pd.concat(held).sort_values(seq, kind="stable")
        n = max(1, len(got) * BLOCK // max(size, 1))
        for i in range(0, len(got), n):
            yield got.iloc[i : i + n]


def _written(blocks: Iterable[pd.DataFrame]) -> IO[bytes]:
    """A run: blocks in a file without a name, on the disk that Spark gives to the task."""
    file = tempfile.TemporaryFile(prefix="millrace-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    for block in blocks:
        raw = pickle.dumps(block)
        pickle.dump((len(raw), pa.compress(raw, "zstd", asbytes=True)), file)
    return file


def _read(file: IO[bytes]) -> Iterator[pd.DataFrame]:
    with file:
        file.seek(0)
        while True:
            try:
                size, packed = pickle.load(file)
            except EOFError:
                return
            yield pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))


def _entries(blocks: Iterable[pd.DataFrame], seq: str, types: pd.Series) -> Iterator[tuple]:
    """((seq is null, seq), segment) of each row, with the types that the whole group's columns have."""
    for block in blocks:
        block = block if block.dtypes.equals(types) else block.astype(types)
        for null, at, segment in zip(block[seq].isna().tolist(), block[seq].tolist(), block.to_dict("records"), strict=True):
            yield (null, None if null else at), segment


def _merged(sources: list[Iterable[pd.DataFrame]], seq: str, types: pd.Series) -> Iterator[dict]:
    return map(itemgetter(1), merge(*(_entries(s, seq, types) for s in sources), key=itemgetter(0)))


def _reblocked(segments: Iterator[dict], n: int) -> Iterator[pd.DataFrame]:
    while got := list(islice(segments, n)):
        yield pd.DataFrame(got)


def ordered(frames: Iterable[pd.DataFrame], seq: str | None) -> Iterator[dict]:
    """Segments as dicts, in the order of seq; equal ones, and all without seq, as they come. Types of columns are those of the
    frames put together."""
    if seq is None:
        for frame in frames:
            yield from frame.to_dict("records")
        return
    levels: list[list] = [[]]
    held, size, rows, head = [], 0, 1, None
    for frame in frames:
        head = frame.iloc[:1] if head is None else pd.concat([head, frame.iloc[:1]]).iloc[:1]
        held.append(frame)
        size += _size(frame)
        if size < RUN:
            continue
        rows = max(1, sum(map(len, held)) * BLOCK // size)
        levels[0].append(_written(_blocks(held, seq, size)))
        held, size = [], 0
        for i in range(len(levels)):
            if len(levels[i]) >= WAYS:
                levels += [[]] if i + 1 == len(levels) else []
                levels[i + 1].append(_written(_reblocked(_merged([_read(f) for f in levels[i]], seq, head.dtypes), rows)))
                levels[i] = []
    if head is not None:
        runs = [f for level in reversed(levels) for f in level]
        yield from _merged([*map(_read, runs), _blocks(held, seq, size)], seq, head.dtypes)

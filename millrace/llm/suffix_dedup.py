"""Exact substring dedup: bytes of repeated 100-byte strings, found by sorting suffixes deep and shallow.

Sorting every suffix of a corpus would move each byte many times over, so suffixes are sorted
only where a repeat is possible. Each window of LENGTH bytes is named by its anchor, the gram of
GRAM bytes in it with the least hash (the last such): equal windows have equal anchors at equal
places. A document's windows with the same anchor are consecutive and form a unit, about one for each
39 bytes. Hashes only say where to look:

1. a task drops the repeats among its own units, byte by byte, and deals the rest by their anchor's hash.
   Anchors that more than one of these units have are flagged;
2. the contents of flagged units are dealt by anchor. Equal ones are told by their bytes. The suffixes of
   the others from the anchor on, and the bytes before it, read backwards, are sorted (multikey
   quicksort to SHALLOW bytes, blind tries beyond), and the lengths of common prefixes tell which
   windows are equal; the earliest stays.

Units move as packed arrays of about 24 bytes each, not as rows. An anchor with many contents (a passage
in many surroundings) is a hot group: gathered in one task it would grow with the corpus. Its units
are spread by content, and step 2 deals their windows, not their contents, by two 64-bit hashes; each task first
drops repeats of its own, byte by byte, so a window costs one entry for each task that has it. Only
these windows are held equal across tasks by their 128 bits. Tasks stream over small buckets, as many as the
input asks for, so none holds more than a bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, partitions

LENGTH, GRAM, SHALLOW = 100, 24, 40
#: Text that is taken at once (positions need 21 bits), that is held before entries are shipped, and that makes a bucket.
CHUNK, FLUSH, BUCKET = 1 << 20, 8 << 20, 4 << 20
#: Contents of an anchor in what one task ships, or in one task of step 1, from which it is spread.
CROWD = 64
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_B1, _B2 = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
_NO_ID = -(1 << 63)
#: What tasks hand on: removals (kind 0: starts and lengths) or flagged units (kind 1; 2 of hot anchors) of a row.
_FOUND = "r long, kind int, data binary"
_BLOB = "bucket int, kind int, rows int, data binary"
_UNIT = np.dtype([("s", "<i8"), ("n", "<i2"), ("a", "<i2"), ("g", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M4
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    return np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,)).copy()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Sums:
    """Polynomial hashes mod 2^64 of stretches of a text, over its mixed 8-byte words."""

    def __init__(self, words: np.ndarray, base: int):
        mixed, self.base = _mix(words * _M1), base
        self.back = _powers(pow(base, -1, 1 << 64), len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(mixed * _powers(base, max(len(words), 1))[: len(words)])]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes begin..end (8 at least)."""
        return _mix((self.sums[end - 7] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * _M2)


def find_units(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Units of texts laid end to end: k (text), s (first window's start in it), n (windows), a (anchor's
    distance from s), g (anchor's hash), u (content's hash). ends: where each text ends."""
    empty = {x: np.zeros(0, dtype=np.uint64 if x in "gu" else np.int64) for x in "ksnagu"}
    begins = np.r_[0, ends[:-1]]
    n_windows = np.maximum(ends - begins - LENGTH + 1, 0)
    if not n_windows.sum():
        return empty
    w = _words(data)
    m = len(w) - (GRAM - 8)
    v = _mix(w[:m] * _M1 + (w[8 : 8 + m] ^ (w[8 : 8 + m] >> np.uint64(31))) * _M2 + _mix(w[16 : 16 + m] * _M3))
    back = np.uint64((1 << 21) - 1)
    low = (v & ~back) | (back - np.arange(m, dtype=np.uint64))
    span, have = LENGTH - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    k = np.repeat(np.arange(len(ends)), n_windows)
    start = np.arange(len(k)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begins[k]
    anchor = (back - (low[start] & back)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (k[1:] != k[:-1])])
    n = np.diff(np.r_[new, len(k)])
    s, p, k = start[new], anchor[new], k[new]
    sums = _Sums(w, _B1)
    u = sums.of(s, s + n + LENGTH - 1) ^ (_mix((p - s).astype(np.uint64) * _M3))
    return {"k": k, "s": s - begins[k], "n": n, "a": p - s, "g": v[p], "u": u}


def _pack(parts: list[tuple[np.ndarray, int]]) -> bytes:
    """Arrays byte plane by byte plane, the lowest first, so many planes of each; zero planes compress to nothing."""
    return b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :k].T.tobytes() for x, k in parts)


def _unpack(blob: bytes, rows: int, planes: list[int]) -> tuple[list[np.ndarray], int]:
    out, at = [], 0
    for k in planes:
        x = np.zeros((rows, 8), dtype=np.uint8)
        x[:, :k] = np.frombuffer(blob, dtype=np.uint8, count=rows * k, offset=at).reshape(k, rows).T
        out.append(x.view(np.int64).ravel())
        at += rows * k
    return out, at


def _zigzag(x: np.ndarray) -> np.ndarray:
    d = np.diff(x, prepend=np.int64(0))
    return (d << np.int64(1)) ^ (d >> np.int64(63))


def _unzigzag(z: np.ndarray) -> np.ndarray:
    return np.cumsum(((z.view(np.uint64) >> np.uint64(1)).view(np.int64)) ^ -(z & 1))


_PLANES = [8, 8, 8, 8, 5, 3]  # g, u, r, d, s, m


def _entries(x: dict[str, np.ndarray]) -> bytes:
    return _pack([(x["g"], 8), (x["u"], 8), (_zigzag(x["r"]), 8), (_zigzag(x["d"]), 8), (x["s"], 5), (x["n"] | x["a"] << 8 | x["hot"] << 16, 3)])


def _read_entries(blob: bytes, rows: int) -> tuple[dict[str, np.ndarray], int]:
    (g, u, r, d, s, m), at = _unpack(blob, rows, _PLANES)
    return {"g": g, "u": u, "r": _unzigzag(r), "d": _unzigzag(d), "s": s, "n": m & 255, "a": m >> 8 & 255, "hot": m >> 16 & 1}, at


def _take(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in x.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _by_row(r: np.ndarray, kind: int, data: np.ndarray) -> pa.RecordBatch:
    """One row for each r, in order, with the bytes of its entries; r is sorted."""
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, dtype=np.int64)
    ends = np.r_[first, len(r)].astype(np.int32) * data.itemsize
    blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.RecordBatch.from_arrays([pa.array(r[first], pa.int64()), pa.array(np.full(len(first), kind, dtype=np.int32)), blobs], names=["r", "kind", "data"])


def _removals(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What windows s..s+n of rows cover, as starts and lengths in bytes; overlapping and touching ones as one."""
    order = np.lexsort((x["s"], x["r"]))
    r, s, e = x["r"][order], x["s"][order], (x["s"] + x["n"])[order] + LENGTH - 1
    if len(r):
        row = np.cumsum(np.r_[0, r[1:] != r[:-1]])
        far = row * (int(e.max()) + 1)  # so that a row's ends are beyond those of rows before it
        upto = np.maximum.accumulate(e + far)
        new = np.r_[True, (s + far)[1:] > upto[:-1]]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(r)] - 1
        r, s, e = r[first], s[first], (upto - far)[last]
    out = np.empty(len(r), dtype=[("s", "<i8"), ("n", "<i8")])
    out["s"], out["n"] = s, e - s
    return _by_row(r, 0, out)


def _flagged(x: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    x = _take(x, np.lexsort((x["s"], x["r"])))
    out = np.empty(len(x["r"]), dtype=_UNIT)
    for c in "snag":
        out[c] = x[c]
    return _by_row(x["r"], kind, out)


def _earliest(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """x sorted by (g, u, d, s); the place of the first entry of each one's content; which start later than it."""
    x = _take(x, np.lexsort((x["s"], x["d"], x["u"], x["g"])))
    first = np.r_[True, (x["g"][1:] != x["g"][:-1]) | (x["u"][1:] != x["u"][:-1])] if len(x["g"]) else np.zeros(0, dtype=bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, dtype=int)
    return x, head, (x["d"] != x["d"][head]) | (x["s"] != x["s"][head])


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n[i] bytes from a[i] on equal those from b[i] on."""
    out, wide = np.zeros(len(a), dtype=bool), np.arange(int(n.max(initial=0)))
    for i in range(0, len(a), 8192):
        p, q, m = a[i : i + 8192, None] + wide, b[i : i + 8192, None] + wide, n[i : i + 8192, None]
        out[i : i + 8192] = ((data[np.minimum(p, len(data) - 1)] == data[np.minimum(q, len(data) - 1)]) | (wide >= m)).all(axis=1)
    return out


def _blob_rows(bucket: list[int], kind: list[int], rows: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "rows", "data"])


def _dealt(y: dict[str, np.ndarray], where: np.ndarray, buckets: int, kind: int, more=None) -> Iterator[pa.RecordBatch]:
    """y in one blob for each bucket; more(places) is appended to each."""
    order = np.lexsort((y["s"], y["r"], where))
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    out: tuple = ([], [], [], [])
    for b in np.flatnonzero(np.diff(cuts)):
        part = order[cuts[b] : cuts[b + 1]]
        for col, v in zip(out, (int(b), kind, len(part), _entries(_take(y, part)) + (more(part) if more else b"")), strict=True):
            col.append(v)
    if out[0]:
        yield _blob_rows(*out)


def _removed(x: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Removals that a task has found, to travel with its blobs, spread by row, as kind 0; rows counts nothing there."""
    got = _removals(x)
    if got.num_rows:
        n = got.num_rows
        where = _mix(got.column("r").to_numpy().view(np.uint64) * _M1) % np.uint64(buckets)
        data = [r.to_bytes(8, "little", signed=True) + d for r, d in zip(got.column("r").to_pylist(), got.column("data").to_pylist(), strict=True)]
        yield _blob_rows(where.tolist(), [0] * n, [1] * n, data)


def _ship(x: dict[str, np.ndarray], data: np.ndarray, buckets: int, kind: int, spread: bool) -> Iterator[pa.RecordBatch]:
    """Drops repeats within x (their removals travel along) and ships the rest in blobs by anchor. x has the place p
    in data of each entry; what hashes hold equal is compared byte by byte."""
    if not len(x["g"]):
        return
    x, head, later = _earliest(x)
    at = np.flatnonzero(later)
    later[at] = (x["n"][at] == x["n"][head[at]]) & (x["a"][at] == x["a"][head[at]]) & _same_bytes(data, x["p"][at], x["p"][head[at]], x["n"][at] + LENGTH - 1)
    gone, x = _take(x, later), _take(x, ~later)
    del x["p"]
    if spread:
        new = np.r_[True, x["g"][1:] != x["g"][:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        x["hot"] = (np.repeat(size, size) > CROWD).astype(np.int64)
        marks = _take(x, np.flatnonzero(new)[size > CROWD])
        marks |= {"n": np.zeros_like(marks["n"]), "hot": np.zeros_like(marks["hot"])}
        x = _joined([x, marks])
    where = np.where((x["hot"] > 0) | (kind == 2), (x["g"] ^ x["u"]), x["g"]) % buckets
    yield from _dealt(x, where, buckets, kind)
    yield from _removed(gone, buckets)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (row, id, begin, bytes) of about FLUSH bytes. Texts beyond CHUNK come in stretches that overlap
    so that each window is whole in one. A unit that is cut in two is two units; equal windows still have equal anchors."""
    held, size, step = [], 0, CHUNK - LENGTH + 1
    for batch in batches:
        for r, d, text in zip(batch.column("r").to_pylist(), batch.column("d").to_pylist(), batch.column("text"), strict=True):
            raw = _raw(text.as_py())
            for at in range(0, max(len(raw) - LENGTH + 1, 1), step):
                held.append((r, d, at, raw[at : at + CHUNK]))
                size += len(held[-1][3])
                if size > FLUSH:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _map_units(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches):
            data = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            rows, ids, begins = (np.array([h[i] for h in held], dtype=np.int64) for i in range(3))
            parts, i = [], 0
            while i < len(held):  # texts of about CHUNK bytes at once
                base = int(ends[i - 1]) if i else 0
                j = max(int(np.searchsorted(ends, base + CHUNK, "right")), i + 1)
                x = find_units(data[base : ends[j - 1]], ends[i:j] - base)
                k = x["k"] + i
                start = np.r_[0, ends[:-1]][k]
                parts.append({"g": x["g"].view(np.int64), "u": x["u"].view(np.int64), "r": rows[k], "d": ids[k], "s": x["s"] + begins[k], "n": x["n"], "a": x["a"], "hot": np.zeros(len(k), dtype=np.int64), "p": x["s"] + start})
                i = j
            yield from _ship(_joined(parts), data, buckets, 1, True)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | dict[int, list[tuple[int, bytes]]]]:
    """Of rows sorted by bucket: removals as they come, and each bucket's blobs by kind."""
    now, got = None, {}
    for batch in batches:
        gone: list[tuple[int, bytes]] = []
        for bucket, kind, rows, data in zip(*(batch.column(c) for c in ("bucket", "kind", "rows", "data")), strict=True):
            kind = kind.as_py()
            if not kind:
                data = data.as_py()
                gone.append((int.from_bytes(data[:8], "little", signed=True), data[8:]))
                continue
            if bucket.as_py() != now:
                if got:
                    yield got
                now, got = bucket.as_py(), {}
            got.setdefault(kind, []).append((rows.as_py(), data.as_py()))
        if gone:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in gone], pa.int64()), pa.array([0] * len(gone), pa.int32()), pa.array([d for _, d in gone], pa.binary())], names=["r", "kind", "data"])
    if got:
        yield got


def _reduce_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags the units whose anchor others have, too."""
    for got in _by_bucket(batches):
        if isinstance(got, pa.RecordBatch):
            yield got
            continue
        x = _joined([_read_entries(d, n)[0] for n, d in got[1]])
        x = _take(x, np.lexsort((x["u"], x["g"])))
        mark = x["n"] == 0  # says that another task's units of this anchor are spread
        marked, x = np.unique(x["g"][mark]), _take(x, ~mark)
        if not len(x["g"]):
            continue
        new = np.r_[True, x["g"][1:] != x["g"][:-1]]
        group = np.cumsum(new) - 1
        contents = np.bincount(group, np.r_[True, (x["u"][1:] != x["u"][:-1]) | new[1:]])[group]
        hot = np.isin(x["g"], marked) | (np.maximum.reduceat(x["hot"], np.flatnonzero(new))[group] > 0) | (contents > 16 * CROWD)
        many = np.bincount(group)[group] > 1
        for kind, use in ((1, many & ~hot), (2, hot)):
            if use.any():
                yield _flagged(_take(x, use), kind)


def _map_contents(buckets: int):
    """Input: r, d, text, kinds, units. Contents of flagged units by anchor, or hashes of hot ones' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: list[dict[str, np.ndarray]] = []
        hot: list[dict[str, np.ndarray]] = []
        texts: list[bytes] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            data = np.frombuffer(b"".join(raws), dtype=np.uint8)
            if hot:
                yield from _ship(_joined(hot), data, buckets, 2, False)
            if cold:
                x = _joined(cold)
                yield from _dealt(x, x["g"] % buckets, buckets, 3, lambda part: b"".join([texts[i] for i in part.tolist()]))
            for held in (cold, hot, texts, raws):
                held.clear()
            size = 0

        for batch in batches:
            for r, d, text, kinds, units in zip(*(batch.column(c) for c in ("r", "d", "text", "kinds", "units")), strict=True):
                r, d, raw = r.as_py(), d.as_py(), _raw(text.as_py())
                by_kind = {k: [np.frombuffer(u, dtype=_UNIT) for j, u in zip(kinds.as_py(), units.as_py(), strict=True) if j == k] for k in (1, 2)}
                if by_kind[1]:
                    u = np.concatenate(by_kind[1])
                    s, n = u["s"].astype(np.int64), u["n"].astype(np.int64)
                    cold.append({"g": u["g"].astype(np.int64), "u": np.zeros(len(u), np.int64), "r": np.full(len(u), r), "d": np.full(len(u), d), "s": s, "n": n, "a": u["a"].astype(np.int64), "hot": np.zeros(len(u), np.int64)})
                    texts += [raw[i : i + k + LENGTH - 1] for i, k in zip(s.tolist(), n.tolist(), strict=True)]
                    size += int(n.sum()) + len(u) * 2 * LENGTH
                if by_kind[2]:
                    w = _words(np.frombuffer(raw, dtype=np.uint8))
                    sums = [_Sums(w, b) for b in (_B1, _B2)]
                    u = np.concatenate(by_kind[2])
                    for i in range(0, len(u), 4096):
                        s, n = u["s"][i : i + 4096].astype(np.int64), u["n"][i : i + 4096].astype(np.int64)
                        at = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        h1, h2 = (x.of(at, at + LENGTH) for x in sums)
                        one, none = np.ones_like(at), np.zeros_like(at)
                        base = sum(map(len, raws))
                        hot.append({"g": h1.view(np.int64), "u": h2.view(np.int64), "r": np.full(len(at), r), "d": np.full(len(at), d), "s": at, "n": one, "a": none, "hot": none, "p": at + base})
                        size += len(at) * 72
                    raws.append(raw)
                    size += len(raw)
                if size > FLUSH:
                    yield from flush()
        yield from flush()

    return run


class _BlindTrie:
    """Orders strings by comparing each with one other: inner nodes hold a depth and, for each branch,
    one byte; what lies between is not stored (Ferragina and Grossi; Manzini and Ferragina)."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def _insert(self, i: int) -> None:
        text = self.strings[i]
        if self.root is None:
            self.root = [i]  # a leaf: equal strings
            return
        node = self.root
        while isinstance(node, tuple):
            depth, branches = node
            node = branches.get(text[depth] if depth < len(text) else -1) or next(iter(branches.values()))
        other = self.strings[node[0]]
        lcp = self._common(text, other)
        if lcp == len(text) == len(other):
            node.append(i)
            return
        above, edge, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            above, edge = node, text[node[0]]
            node = node[1][edge]
        own = text[lcp] if lcp < len(text) else -1
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][own] = [i]
            return
        fork = (lcp, {(other[lcp] if lcp < len(other) else -1): node, own: [i]})
        if above is None:
            self.root = fork
        else:
            above[1][edge] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def suffix_order(table: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of strings (rows of a byte table, padded with zeros) within groups, by deep-shallow sorting.

    Shallow: multikey quicksort with 8 bytes as one letter. Each group that is not yet in order is split
    by a pivot (the median of its first, middle and last letter) into less, equal and greater; what is
    equal goes on to the next letter, to SHALLOW bytes. All groups take a step at once. Deep: groups that are still
    equal have long common prefixes, and a blind trie orders each.
    """
    order = np.lexsort((lengths, group))
    letters = np.ascontiguousarray(table).view(">u8")[:, : SHALLOW // 8].astype(np.uint64)
    first = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    size, depth = np.diff(np.r_[first, len(order)]), np.zeros(len(first), dtype=np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        done = (depth == SHALLOW // 8) & (size > 1)
        if done.any():
            deep.append((first[done], size[done]))
        go = (size > 1) & ~done
        first, size, depth = first[go], size[go], depth[go]
        if not len(first):
            break
        seg = np.repeat(np.arange(len(first)), size)
        begin = np.cumsum(size) - size
        at = first[seg] + np.arange(len(seg)) - begin[seg]
        key = letters[order[at], depth[seg]]
        ends = np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]])
        pivot = np.sort(ends, axis=0)[1][seg]
        side = seg * 3 + (key >= pivot) + (key > pivot)
        by = np.argsort(side, kind="stable")
        order[at], side = order[at[by]], side[by]
        new = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        first, size, depth = at[new], np.diff(np.r_[new, len(side)]), depth[side[new] // 3] + (side[new] % 3 == 1)
    for begins, sizes in deep:
        for i, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            rows = order[i : i + n]
            order[i : i + n] = rows[_BlindTrie([table[r, : lengths[r]].tobytes() for r in rows.tolist()]).order()]
    return order


def _classes(table: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common prefix of each with the one before it (-1 at a group's begin)."""
    order = suffix_order(table, lengths, group)
    a, b = order[1:], order[:-1]
    differ = table[a] != table[b]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    lcp = np.minimum(lcp, np.minimum(lengths[a], lengths[b]))
    lcp[group[a] != group[b]] = -1
    return order, np.r_[-1, lcp]


def _cut_out(data: np.ndarray, begin: np.ndarray, step: int, n: np.ndarray, width: int) -> np.ndarray:
    """A table of the n[i] bytes from begin[i] on, forwards or backwards, padded with zeros."""
    out, wide = np.zeros((len(begin), width), dtype=np.uint8), np.arange(width)
    for i in range(0, len(begin), 8192):
        at = np.clip(begin[i : i + 8192, None] + step * wide, 0, len(data) - 1)
        out[i : i + 8192] = np.where(wide < n[i : i + 8192, None], data[at], 0)
    return out


def repeated_windows(x: dict[str, np.ndarray], data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (unit, first window, windows) of windows with an earlier equal one among units with the same g. A unit's
    content begins at p in data."""
    m, width = len(x["p"]), LENGTH - GRAM + 1
    a, n = x["a"], x["n"]
    _, group = np.unique(x["g"], return_inverse=True)
    r_len, l_len = np.minimum(n + LENGTH - 1 - a, LENGTH), a
    right, left = _cut_out(data, x["p"] + a, 1, r_len, 104), _cut_out(data, x["p"] + a - 1, -1, l_len, 80)
    (r_order, r_lcp), (l_order, l_lcp) = _classes(right, r_len, group), _classes(left, l_len, group)
    rank = np.lexsort((x["s"] + a, x["d"]))
    d, p = x["d"], x["s"] + a
    gone = np.zeros((m, width + 1), dtype=bool)  # by window of the unit
    r_class, l_class = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for back in range(width):
        use = rank[(a[rank] >= back) & (a[rank] - n[rank] < back)]
        if len(use) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < LENGTH - back)
        l_class[l_order] = np.cumsum(l_lcp < back)
        key = l_class[use] * (m + 1) + r_class[use]
        by = np.argsort(key, kind="stable")
        key, use = key[by], use[by]
        head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
        late = use[(d[use] != d[use[head]]) | (p[use] != p[use[head]])]
        gone[late, a[late] - back] = True
    edge = np.diff(gone.astype(np.int8), axis=1, prepend=0)
    unit, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return unit, begin, end - begin


def _told_apart(x: dict[str, np.ndarray], data: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Removals (r, s, n) among units whose contents begin at p in data, anchor by anchor."""
    x = _take(x, np.lexsort((x["s"], x["d"])))
    raw, seen = data.tobytes(), {}
    key = zip(x["g"].tolist(), x["a"].tolist(), x["p"].tolist(), (x["p"] + x["n"] + LENGTH - 1).tolist(), strict=True)
    head = np.array([seen.setdefault((g, a, raw[i:j]), k) for k, (g, a, i, j) in enumerate(key)], dtype=np.int64)
    del seen, raw
    later = (x["d"] != x["d"][head]) | (x["s"] != x["s"][head])
    yield _take(x, later)
    own = np.flatnonzero(head == np.arange(len(head)))
    twins = np.flatnonzero((head != np.arange(len(head))) & ~later)  # the same place of the same id: they share their head's lot
    y = _take(x, own)
    order = np.argsort(y["g"], kind="stable")
    g = y["g"][order]
    at = 0
    while at < len(order):  # an anchor's units stay together
        end = int(np.searchsorted(g, g[min(at + (1 << 15), len(g)) - 1], "right"))
        part = order[at:end]
        unit, begin, n = repeated_windows(_take(y, part), data)
        gone = own[part[unit]]
        yield {"r": x["r"][gone], "s": x["s"][gone] + begin, "n": n}
        if len(twins):
            by = np.argsort(head[twins], kind="stable")
            lo, hi = (np.searchsorted(head[twins][by], gone, side) for side in ("left", "right"))
            which = np.repeat(np.arange(len(gone)), hi - lo)
            twin = twins[by][np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            yield {"r": x["r"][twin], "s": x["s"][twin] + begin[which], "n": n[which]}
        at = end


def _reduce_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _by_bucket(batches):
        if isinstance(got, pa.RecordBatch):
            yield got
            continue
        if 2 in got:
            x, _, later = _earliest(_joined([_read_entries(d, n)[0] for n, d in got[2]]))
            yield _removals(_take(x, later))
        if 3 in got:
            parts, contents, base = [], [], 0
            for rows, data in got[3]:
                x, at = _read_entries(data, rows)
                size = x["n"] + LENGTH - 1
                parts.append(x | {"p": base + np.cumsum(size) - size})
                contents.append(data[at:])
                base += len(contents[-1])
            got.clear()
            data = np.frombuffer(b"".join(contents), dtype=np.uint8)
            del contents
            for gone in _told_apart(_joined(parts), data):
                if len(gone["r"]):
                    yield _removals(gone)


def _cut(text: str | None, gone: list[bytes] | None) -> tuple[bytes, int, int, int]:
    raw = _raw(text)
    if gone is None or not len(gone):
        return raw, len(raw), 0, 0
    found = np.concatenate([np.frombuffer(g, dtype=np.int64).reshape(-1, 2) for g in gone])
    found = found[np.argsort(found[:, 0], kind="stable")]
    upto = np.maximum.accumulate(found.sum(axis=1))
    first = np.flatnonzero(np.r_[True, found[1:, 0] > upto[:-1]])
    begins, ends = found[first, 0].tolist(), upto[np.r_[first[1:], len(found)] - 1].tolist()
    kept = b"".join([raw[i:j] for i, j in zip([0, *ends], [*begins, len(raw)], strict=True)])
    return kept, len(raw), len(raw) - len(kept), len(begins)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with kept (binary, what is left of the text's UTF-8), n_bytes, n_removed, n_spans.

    A byte goes if a LENGTH-byte string covers it that also starts earlier: in a document with a smaller
    id, or in the same document before it. Strings overlap, never cross documents, and are judged on the
    input, not on what is left.

    Null text: empty. Null id: before all others. Rows that repeat an id, null ids among them, are one document: what
    starts at the same place of the same id is not earlier, so repeated rows come out alike, and rows that share
    an id but not their text are each cut by their own. Very long texts are taken in stretches. Empty table: no
    rows. Columns named as the added ones are replaced.

    Rows are told apart by a number written with the texts, so a lost executor does not renumber them.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "suffix"), partitions(spark)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "__r")
    rows = scratch.keep(docs.withColumn("__r", F.monotonically_increasing_id()))
    own = rows.select(F.col("__r").alias("r"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    dealt = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    step1 = scratch.keep(dealt(own.mapInArrow(_map_units(buckets), _BLOB)).mapInArrow(_reduce_units, _FOUND))
    units = step1.where("kind > 0").groupBy("r").agg(F.collect_list(F.struct("kind", "data")).alias("u"))
    met = own.join(units, "r").select("r", "d", "text", F.col("u.kind").alias("kinds"), F.col("u.data").alias("units"))
    step2 = scratch.keep(dealt(met.mapInArrow(_map_contents(buckets), _BLOB)).mapInArrow(_reduce_contents, _FOUND))
    gone = step1.where("kind = 0").union(step2).groupBy(F.col("r").alias("__r")).agg(F.collect_list("data").alias("__gone"))

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def cut(text, gone):
        import pandas as pd

        return pd.DataFrame([_cut(t, g) for t, g in zip(text, gone, strict=True)], columns=["kept", "n_bytes", "n_removed", "n_spans"])

    out = rows.join(gone, "__r", "left")
    return out.withColumn("__cut", cut(F.col(text_col), F.col("__gone"))).select(*docs.columns, "__cut.*")

"""Nearest neighbours by inner product, from randomly rotated one-bit codes (RaBitQ, Gao and Long, 2024)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

#: Vectors that the lists' centres are fitted on at most, chosen by a hash of their id.
SAMPLE = 20_000
#: Most vectors, and most queries, that meet in one group.
CELL = 4096
#: One in so many of a query's lists, its nearest, is visited first.
NEAREST = 16
#: Standard deviations of the estimate that the error bound spans.
SPAN = 3.0


@dataclass
class Index:
    """Centres of the lists and the rotation; both are bounded by the sample, not by the table."""

    centres: np.ndarray
    turn: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T, axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of the rotated residuals, the residuals' lengths, and each code's inner product with
        the unit residual that it stands for."""
        r = x - self.centres[lists]
        length = np.linalg.norm(r, axis=1)
        v = r @ self.turn
        fit = np.abs(v).sum(axis=1) / np.maximum(length, 1e-30) / math.sqrt(v.shape[1])
        return np.packbits(v > 0, axis=1), length, np.where(length > 0, fit, 1.0)

    def estimate(self, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For (queries, vectors) of one list: estimated inner products and bounds of their errors."""
        d = self.turn.shape[1]
        signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
        turned = (q @ self.turn).astype(np.float32)
        scale = (length / fit / math.sqrt(d)).astype(np.float32)
        est = (q @ self.centres[centre])[:, None] + (turned @ signs.T) * scale[None, :]
        off = length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * SPAN / math.sqrt(max(d - 1, 1)) + 1e-5 * length
        return est, np.linalg.norm(q, axis=1)[:, None] * off[None, :]


def fit_index(sample: np.ndarray, n_lists: int, seed: int = 2024) -> Index:
    """k-means on the sample (10 rounds) and a random rotation, of the dimension padded to whole bytes."""
    rng = np.random.default_rng(seed)
    n_lists = max(1, min(n_lists, len(sample)))
    centres = sample[rng.choice(len(sample), n_lists, replace=False)].copy()
    for _ in range(10):
        own = Index(centres, np.eye(sample.shape[1])).assign(sample)
        n = np.bincount(own, minlength=n_lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.choice(len(sample), n_lists)])
    wide = -(-sample.shape[1] // 8) * 8
    turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0][: sample.shape[1]]
    return Index(centres, turn)


def choose_probes(index: Index, sample: np.ndarray, k: int, recall: float = 0.97, n_queries: int = 400) -> int:
    """How many lists queries must visit to find so large a share of their k nearest, by the sample: the
    nearest of a few hundred of its vectors by brute force, and the places of their lists in the queries' order."""
    n = len(index.centres)
    if n == 1 or len(sample) < 2:
        return n
    q = sample[:: max(1, len(sample) // n_queries)][:n_queries]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q)) * max(1, len(sample) // n_queries)] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    order = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
    visited = np.sort(np.take_along_axis(place, index.assign(sample)[best], axis=1).ravel())
    return int(visited[min(len(visited) - 1, int(recall * len(visited)))]) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def top_in_list(index: Index, centre: int, ids: np.ndarray, x: np.ndarray, codes: tuple, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best among the list's vectors, those of its own id and scores below
    `least` left out.

    Only vectors whose upper bound reaches `least` and the k-th largest lower bound are looked at; the score of these
    is the exact inner product. Equal vectors get equal scores, as each row is summed on its own.
    """
    out: tuple[list, list, list] = ([], [], [])
    for i in range(0, len(q), 128):
        est, off = index.estimate(*codes, centre, q[i : i + 128])
        low, high = est - off, est + off
        own = q_ids[i : i + 128, None] == ids[None, :]
        low[own] = -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        a, b = np.nonzero((high >= np.maximum(kth, least[i : i + 128])[:, None]) & ~own)
        score = np.concatenate([np.zeros(0), *((x[b[p : p + 16384]] * q[i + a[p : p + 16384]]).sum(axis=1) for p in range(0, len(a), 16384))])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        best = (place < k) & (score >= least[i + a])
        out[0].append(q_ids[i + a[best]])
        out[1].append(ids[b[best]])
        out[2].append(score[best])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)  # type: ignore[return-value]


def nearest(vectors: DataFrame, is_query, k: int = 20, probes: int | None = None, lists: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows by largest inner product: query_id, rank (from 1), vec_id, score.

    is_query: a condition on vectors; candidates are all rows but those with the query's own id. Ties go to
    the smaller id. Vectors are put in lists (as many as the root of their number, up to a twentieth of the
    sample) by their nearest centre; a query visits the `probes` lists (default: by choose_probes(), so that
    97 % of the nearest are found) whose centres have the largest inner product with it. Every row is indexed; only
    the centres come from a sample of at most `sample` rows. Within a list, one-bit codes
    choose what is compared exactly.

    A query first visits a NEAREST-th of its lists. The k-th largest score found there bounds the final one from below, so
    from the other lists only vectors that may reach it come back, not k for each list.

    Lists and their queries are split by hash into cells of about CELL of each, so a list that holds a third of all
    vectors is shared out.

    Null vectors, and such that are zero or hold null or non-finite components, take no part, nor do those of
    another than the most common dimension, nor rows with null ids. Rows that repeat an id are kept once for each vector
    that they hold as candidates, and the best counts. Very long vectors are taken whole. No rows: no rows. Only id_col,
    vector_col and what is_query reads are looked at, so other columns can't clash.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    scratch = Scratch(spark, "rabitq")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("x"), is_query.alias("q"))
    shape = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], shape)
    dim, n = common["d"], common["count"]
    rows = rows.where(F.size("x") == dim)
    drawn = rows.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("x").toArrow()["x"].combine_chunks()
    drawn = _matrix(drawn, dim)
    index = fit_index(drawn, lists or max(1, min(math.isqrt(n), len(drawn) // 20)))
    n_lists = len(index.centres)
    probes = min(n_lists, probes or choose_probes(index, drawn, k))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            own = index.assign(x)
            bits, length, fit = index.encode(x, own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), batch.column("q"), pa.array(own.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(fit)], names=["id", "x", "q", "list", "bits", "length", "fit"])

    def route(begin: int, end: int):
        """Queries (id, x, least) to their lists from the begin-th nearest on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 1000):
                    batch = whole.slice(i, 1000)
                    x = _matrix(batch.column("x"), dim)
                    to = np.argsort(-(x @ index.centres.T), axis=1, kind="stable")[:, begin:end]
                    at = pa.array(np.repeat(np.arange(len(x)), to.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "x", "least")), pa.array(to.ravel().astype(np.int32))], names=["id", "x", "least", "list"])

        return run

    coded = scratch.keep(rows.mapInArrow(code, "id long, x array<double>, q boolean, list int, bits binary, length double, fit double"))
    # Numbers of rows for each list; there are at most sample / 20 lists.
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}
    split = np.array([max(1, math.ceil(sizes.get(i, 0) / CELL)) for i in range(n_lists)])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        a, b = a.combine_chunks(), b.combine_chunks()
        get = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
        bits = np.frombuffer(b"".join(get(a, "bits").to_pylist()), dtype=np.uint8).reshape(a.num_rows, -1)
        codes = (bits, get(a, "length").to_numpy(), get(a, "fit").to_numpy())
        found = top_in_list(index, get(a, "list")[0].as_py(), get(a, "id").to_numpy(), _matrix(get(a, "x"), dim), codes, get(b, "id").to_numpy(), _matrix(get(b, "x"), dim), get(b, "least").to_numpy(), k)
        return pa.table([pa.array(c.astype(t)) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)], names=names)

    def visit(asked: DataFrame) -> DataFrame:
        """The best of each query in each cell of its lists."""
        calls = {r["list"]: r["n"] for r in asked.select("list").groupBy("list").agg(F.count("*").alias("n")).collect()}
        turns = np.array([max(1, math.ceil(calls.get(i, 0) / CELL)) for i in range(n_lists)])
        base = np.r_[0, np.cumsum(split * turns)]

        def cells(of_rows: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = batch.column("list").to_numpy()
                    ids = batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)
                    h = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                    part, other = (h % split[own], turns[own]) if of_rows else (h % turns[own], split[own])
                    at = np.repeat(np.arange(len(own)), other)
                    n = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
                    cell = base[own[at]] + (part[at] * turns[own[at]] + n if of_rows else n * turns[own[at]] + part[at])
                    took = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *(batch.column(c).take(took) for c in batch.schema.names)], names=["cell", *batch.schema.names])

            return run

        left = coded.select("id", "x", "list", "bits", "length", "fit").mapInArrow(cells(True), "cell long, id long, x array<double>, list int, bits binary, length double, fit double")
        right = asked.mapInArrow(cells(False), "cell long, id long, x array<double>, least double, list int")
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    first = max(1, probes // NEAREST)
    routed = "id long, x array<double>, least double, list int"
    queries = coded.where("q").select("id", "x")
    asked = queries.withColumn("least", F.lit(float("-inf"))).mapInArrow(route(0, first), routed)
    near = scratch.keep(best(visit(asked)).select("query_id", "vec_id", "score"))
    if first == probes:
        return best(near).select("query_id", "rank", "vec_id", "score")
    bound = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "least")
    asked = queries.join(bound, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).mapInArrow(route(first, probes), routed)
    return best(near.union(visit(asked))).select("query_id", "rank", "vec_id", "score")

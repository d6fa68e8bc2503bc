"""Near duplicates by the Jaccard similarity of word shingles, exactly: SimHash links and a prefix-filtered join, every pair verified."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.scratch import Scratch
from millrace.llm.simhash import fingerprint, link_fingerprints, shingle_hashes

#: Documents whose shingles are counted, and shingles taken from them, to put common ones last. They set an order only: any order finds the same pairs.
SAMPLE, COMMON = 10_000, 50_000
#: Texts that share a shingle and are compared at once; more are first joined through leaders, then dealt in chunks.
BUCKET, CHUNK = 64, 1024
#: Of those compared at once, so many are joined to pairs. More are rows with bitmaps, compared inside tasks: from about a dozen
#: on these are fewer bytes.
PAIRS = 12
#: Rounds in which the rows of large buckets meet one leader each.
ROUNDS = 2
#: Bits of the table that tells which ids can't be in a list.
BITS = 1 << 24
#: Longs in a text's parity bitmap.
WORDS = 8
_ROW = "id long, k long, fp long, n int, " + ", ".join(f"s{i} long" for i in range(WORDS))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """Equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(a.view(np.int64) for a in arrays)])))


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a set's parity bitmap of so many bits."""
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _map(s: np.ndarray) -> bytes:
    """A parity bitmap that grows with the set: of the power of two of bits from twice its size on."""
    return _parity(s, max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64).tobytes()


def _prefixes(words: int, common: list[int]):
    """Of each text: id, key of its set, SimHash, size and bitmaps (of one size, and as large as the set) of the set, and the first shingles, of which any set at 0.8 or more holds one."""
    rank = np.array(common, dtype=np.int64).view(np.uint64)  # commonest first
    order = np.argsort(rank)
    ranked = rank[order]

    def first(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ranked, s), max(len(ranked) - 1, 0))
        late = np.where(ranked[at] == s, len(ranked) - order[at], 0) if len(ranked) else np.zeros(len(s), np.int64)
        return s[np.lexsort((s, late))][: len(s) - (4 * len(s) + 4) // 5 + 1] if len(s) else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                hashes = [np.array(shingle_hashes(t, words), dtype=np.uint64) for t in batch.column(1).to_pylist()]
                sets, fps = [np.unique(h) for h in hashes], np.array([fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)
                maps = np.array([_parity(s, 64 * WORDS).view(np.int64) for s in sets]).reshape(-1, WORDS)
                columns = [batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(maps[:, j])) for j in range(WORDS)), pa.array([_map(s) for s in sets], pa.binary()), _lists([first(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "fp", "n", *(f"s{j}" for j in range(WORDS)), "map", "prefix"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), _lists(sets)], names=["id", "k", "x"])

    return run


def _common(own: DataFrame, words: int) -> list[int]:
    share = max(1, own.count() // SAMPLE)
    counted = own.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).mapInArrow(_sets(words), "id long, k long, x array<long>")
    counted = counted.select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n > 2")
    return [r.x for r in counted.orderBy(F.desc("n"), "x").limit(COMMON).collect()]


def _listed(rows: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """The rows whose id_col may be in ids, all that are included; by left_anti the others, those without an id included.
    The table that tells has a fixed size, so what follows need not shuffle all texts to meet a part of them, and only
    the rows asked for leave the join."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITS))
    bits = ids.select(at(ids.columns[0]).alias("h")).groupBy(F.expr("h div 64").alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("__bits"))
    hit = F.expr("__h div 64 = __w and (shiftright(__bits, cast(__h % 64 as int)) & 1L) = 1")
    return rows.withColumn("__h", F.when(F.col(id_col).isNotNull(), at(id_col))).join(F.broadcast(bits), hit, how).drop("__h")


def _met(a: DataFrame, b: DataFrame, on: list[str], nodes: DataFrame, scratch: Scratch, extra: str = "true", unseen: str = "least(ha, hb)") -> DataFrame:
    """Distinct pairs (a, b) of rows that share a shingle and whose sizes, places of it and bitmaps allow 0.8.

    Sets of n and m shingles at 0.8 share 4/9 of n + m at least and differ in 1/9 of it at most. The
    bits in which two parity bitmaps differ are never more than the shingles in which the sets do.
    What they share is in both prefixes, or in the rest of the one that ends earlier; of the shared
    part of the prefixes, `unseen` bounds what rows of other buckets hold.
    """
    a, b = (x.select(*on, *(F.col(c).alias(f"{c}_{s}") for c in x.columns if c not in on)) for x, s in ((a, "a"), (b, "b")))
    pairs = a.join(b, on).where(extra).where("9 * (least(n_a - pos_a, n_b - pos_b) + least(pos_a, pos_b)) >= 4 * (n_a + n_b) and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    pairs = pairs.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b")).where("a != b").groupBy("a", "b").agg(F.count("*").alias("seen"))
    met = pairs = scratch.keep(pairs)
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("k").alias(s), F.col("n").alias(f"n{s}"), F.col("h").alias(f"h{s}"), F.col("p").alias(f"p{s}"), *(F.col(f"s{i}").alias(f"s{i}{s}") for i in range(WORDS))), s)
    differ = " + ".join(f"bit_count(s{i}a ^ s{i}b)" for i in range(WORDS))
    pairs = pairs.where(f"9 * ({differ}) <= na + nb and 9 * (seen + {unseen} + greatest(na - pa, nb - pb)) >= 4 * (na + nb)").select("a", "b")
    out = scratch.keep(pairs)
    scratch.drop(met)
    return out


def _differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer one folded to the other's bits."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def _fit_by_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [9 * _differing(x, y) <= n + m for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("na", "xa", "nb", "xb")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])


def _verifier(texts: DataFrame, reps: DataFrame, maps: DataFrame, words: int, scratch: Scratch) -> Callable[[DataFrame], DataFrame]:
    """pairs (a, b), a table -> those at 0.8, a table.

    Sets are made from the texts of these pairs alone, and only where bitmaps as large as the sets leave a doubt,
    so what is shuffled follows the links and not the texts that some common shingle brings together. The bitmaps were made
    with the prefixes, so each call reads the texts once, or not at all.
    """

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("k")).union(pairs.select("b"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = scratch.keep(ends(pairs).distinct().join(reps, "k").select("k", F.col("id").alias("own")))
        held = _listed(texts, wanted.select("own"), "id").select("id", "text").mapInArrow(_sets(words), "id long, k long, x array<long>")
        out = scratch.keep(held.join(wanted, "k").where("id = own").dropDuplicates(["k"]).drop("id", "own"))
        scratch.drop(wanted)
        return out

    def beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(of.withColumnsRenamed({c: s if c == "k" else f"{c}{s}" for c in of.columns}), s)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        held = scratch.keep(_listed(maps, ends(pairs), "k"))
        near = scratch.keep(beside(pairs, held).select("a", "b", "na", "xa", "nb", "xb").mapInArrow(_fit_by_maps, "a long, b long"))
        scratch.drop(held)
        if near.isEmpty():
            return near
        sets = sets_of(near)
        out = scratch.keep(beside(near, sets).where(9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.size("xa") + F.size("xb"))).select("a", "b"))
        scratch.drop(sets, near)
        return out

    return verified


def _cell_pairs(k: np.ndarray, n: np.ndarray, pos: np.ndarray, c: np.ndarray, left: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows, of different components, that sizes, places and bitmaps allow: those of left rows with the
    others or, where all are left, among themselves. Rows are compared in blocks; only what is left is handed on."""
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    own = not len(b)
    b = a if own else b
    out: tuple[list, list] = ([], [])
    for i in range(0, len(a), 64):
        p = a[i : i + 64, None]
        both = n[p] + n[b]
        fits = (c[p] != c[b]) & (9 * (np.minimum(n[p] - pos[p], n[b] - pos[b]) + np.minimum(pos[p], pos[b])) >= 4 * both) & (5 * np.minimum(n[p], n[b]) >= 4 * np.maximum(n[p], n[b]))
        if own:
            fits &= k[p] < k[b]
        x, y = np.nonzero(fits)
        x, y = a[i + x], b[y]
        near = 9 * np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
        out[0].append(np.minimum(k[x], k[y])[near])
        out[1].append(np.maximum(k[x], k[y])[near])
    return np.concatenate([np.zeros(0, np.int64), *out[0]]), np.concatenate([np.zeros(0, np.int64), *out[1]])


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell (x, y, z), of two chunks at most, so a cell is bounded."""
    held: list[np.ndarray] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            part = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]
            held = [np.concatenate(p) for p in zip(held, part, strict=True)] if held else part
        if not held or not len(held[0]):
            continue
        x, y, z = held[:3]
        new = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])) + 1
        cuts = [0, *new.tolist()] + ([len(x)] if batch is None else [])
        found = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            k, n, pos, c, at = (v[i:j] for v in held[3:8])
            found.append(_cell_pairs(k, n, pos, c, at == y[i], np.stack([v[i:j] for v in held[8:]], axis=1).view(np.uint64)))
        held = [v[cuts[-1] :] for v in held]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], names=["a", "b"])


def _alike(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs that SimHash links: sets of one fingerprint with one of them, and fingerprints that blocks and pivot tables join."""
    fps = scratch.keep(nodes.groupBy("fp").agg(F.min("k").alias("rep")))
    pairs = nodes.join(fps, "fp").select(F.col("k").alias("a"), F.col("rep").alias("b")).union(link_fingerprints(fps, scratch).select("a", "b"))
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _found(dealt: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs that meet in cells (x, y, z) and may be at 0.8, a table."""
    bits = [f"s{i}" for i in range(WORDS)]
    cells = dealt.join(nodes.select("k", *bits), "k").select("x", "y", "z", "k", "n", "pos", "c", "at", *bits)
    return scratch.keep(cells.repartition("x", "y", "z").sortWithinPartitions("x", "y", "z").mapInArrow(_in_cells, "a long, b long").distinct())


def _hot_links(hot: DataFrame, links: DataFrame, nodes: DataFrame, verified: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Links that join what the pairs within large buckets join, those of `links` included.

    A group of near copies would give pairs in the square of its size, so its rows first meet leaders. In each
    round a row that is not of the largest component of some bucket of its own takes the one of these buckets that
    a hash puts first (near copies mostly take the same) and meets a leader of that component: a pair for each row,
    however many buckets it is in. What that joins is not compared again: buckets of one component are done, and
    in others only rows of different components meet. The rows of a bucket's largest component and the others
    are dealt in chunks; two chunks meet in one place.
    """

    spent: list[DataFrame] = []

    def placed() -> tuple[DataFrame, DataFrame]:
        """The rows with their component, in buckets of more than one, and these buckets' largest components. Links become
        stars of components, which later rounds settle at once."""
        nonlocal links
        before, links = links, scratch.keep(connected_components(links, scratch).select(F.col("node").alias("a"), F.col("component").alias("b")))
        scratch.drop(before)
        of = links.toDF("k", "component")
        rows = scratch.keep(hot.join(of, "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component"))
        most = rows.groupBy("x", "c").agg(F.count("*").alias("m")).groupBy("x").agg(F.sum("m").alias("all"), F.max(F.struct("m", "c")).alias("top")).where("all > top.m")
        most = scratch.keep(most.select("x", F.col("top.c").alias("top"), F.ceil(F.col("top.m") / CHUNK).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("top.m")) / CHUNK).cast("int").alias("others")))
        spent.extend((rows, most))
        return rows.join(most, "x").withColumn("is_top", F.col("c") == F.col("top")), most

    for turn in range(ROUNDS):
        rows, most = placed()
        if most.isEmpty():
            return links
        leaders = rows.where("is_top").groupBy("x").agg(F.min(F.struct(F.xxhash64("x", "k", F.lit(turn)).alias("h"), "k", "n", "pos")).alias("l")).select("x", "l.k", "l.n", "l.pos")
        chosen = rows.where("not is_top").groupBy("k").agg(F.min(F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), "x", "n", "pos")).alias("l")).select("l.x", "k", "l.n", "l.pos")
        before, links = links, scratch.keep(links.union(verified(_met(chosen, leaders, ["x"], nodes, scratch, unseen="least(pa, pb)"))))
        scratch.drop(before, *spent)
        spent.clear()
    dealt, _ = placed()
    dealt = dealt.withColumn("at", F.when(F.col("is_top"), F.col("others") + F.pmod(F.xxhash64("k"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("k"), F.col("others"))).cast("int"))
    last = F.when(F.col("is_top"), F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1)
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), last))).withColumns({"y": F.least("at", "to"), "z": F.greatest("at", "to")})
    return links.union(verified(_found(dealt, nodes, scratch)))


def near_texts(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of each row with an id: the smallest id that can be reached over texts whose
    sets of shingles have a Jaccard similarity of 0.8 or more, its own included.

    Shingles as in SimHash: A-Z lower-cased, fewer words make one shingle, texts without words are alike.
    Rows that share an id are one document. SimHash (2 differing bits) proposes links, which large groups of near
    copies then need not be compared for; it misses most edits, so a join finds the others. Every pair at 0.8 is found: of each set in one common
    order the first fifth and one shingle more are dealt by shingle, and two sets at 0.8 share one of
    these. Sizes, places and bitmaps only rule out pairs that can't reach 0.8; the rest are verified
    on whole sets. Equal sets are one node.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shingle_pairs")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = scratch.keep(texts.mapInArrow(_prefixes(words, _common(texts, words)), f"{_ROW}, map binary, prefix array<long>"))
    reps = scratch.keep(own.groupBy("k").agg(F.min("id").alias("id")))
    nodes = scratch.keep(own.join(reps, ["id", "k"]).dropDuplicates(["id", "k"]))
    ids = scratch.keep(own.select("id", "k"))
    scratch.drop(own)
    maps = scratch.keep(nodes.select("k", "n", F.col("map").alias("x")))
    rows = nodes.select("k", "n", F.posexplode("prefix").alias("pos", "x"))
    counts = scratch.keep(rows.groupBy("x").agg(F.count("*").alias("m")).where("m > 1"))
    shared = scratch.keep(rows.join(counts, "x"))
    few = min(PAIRS, BUCKET)
    crowded = shared.where(f"m > {few}").groupBy("k").agg(F.count("*").cast("int").alias("h"))
    slim = nodes.withColumn("p", F.size("prefix")).drop("prefix", "map", "id").join(crowded, "k", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    slim = scratch.keep(slim)
    scratch.drop(nodes, counts)
    nodes = slim
    small, some, hot = (shared.where(c).drop("m") for c in (f"m <= {few}", f"m > {few} and m <= {BUCKET}", f"m > {BUCKET}"))
    pairs = _met(small, small, ["x"], nodes, scratch, "k_a < k_b")
    zero = F.lit(0)
    cells = _found(some.withColumns({"y": zero, "z": zero, "at": zero, "c": F.col("k")}), nodes, scratch)
    pairs = scratch.keep(pairs.union(cells).union(_alike(nodes, scratch)).distinct())
    verified = _verifier(texts, reps, maps, words, scratch)
    links = verified(pairs)
    if not hot.isEmpty():
        links = scratch.keep(_hot_links(hot, links, nodes, verified, scratch))
    for s in "ab":
        links = links.join(reps.select(F.col("k").alias(s), F.col("id").alias(f"id_{s}")), s)
    of = connected_components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), scratch)
    named = scratch.keep(reps.join(of, reps.id == of.node, "left").select("k", F.coalesce("component", "id").alias("component_id")))
    out = scratch.keep(ids.join(named, "k").select(F.col("id").alias(id_col), "component_id"))
    scratch.drop(ids, nodes, maps, shared, pairs)
    return out


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest. Rows with a null id stay; rows that
    repeat an id are one document and stay or go together."""
    marked = near_texts(docs, words, id_col, text_col)
    gone = marked.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    gone = Scratch(docs.sparkSession, "shingle_gone").keep(gone)
    stay = _listed(docs, gone, id_col, "left_anti")
    return stay.union(_listed(docs, gone, id_col).join(gone, id_col, "left_anti").select(*docs.columns))

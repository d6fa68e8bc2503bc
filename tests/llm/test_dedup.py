"""Line, substring and SimHash dedup against brute force on small texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import line_dedup, simhash, suffix_dedup
from millrace.llm.scratch import Scratch

SHAPE = "doc_id long, text string, h string, id int"
SPACES = "\t\n\x0b\x0c\r "
LONG = "The Same Line That Many Documents Share, Word For Word"
UP = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(SPACES).translate(UP)


def lines_of(rows):
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                docs[key(line)].add(i)
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        stay = [x for x in ls if i is None or len(docs[key(x)]) < 5 or i == max(docs[key(x)])]
        out.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rows = [(i, f"own {i}\n  {LONG} \r\nüÄ" + f"\n{LONG.upper()}" * (i % 3)) for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, LONG), (23, LONG), (23, LONG), (24, "x" * 300_000), (25, LONG + "\n" + "\n".join(str(k) for k in range(20_000))), (5, LONG + "\nother text of the same id")]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == lines_of(rows)


def test_lines_of_a_long_text_and_clashing_columns(spark):
    long = "\n".join([LONG, *(str(k) for k in range(100_000)), LONG])
    rows = [(i, LONG) for i in range(1, 7)] + [(0, long)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE).withColumnRenamed("id", "n_lines").withColumnRenamed("h", "n_dropped")
    out = line_dedup.dedup_lines(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == lines_of(rows)


def test_lines_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SHAPE)).count() == 0


def repeats_of(rows):
    raw = [(i if i is not None else -(1 << 63), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, t), (j, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (j, s):
                gone[s : s + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(out):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.mark.parametrize("crowd", [64, 1])
def test_repeats_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    shared = [prose(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(5, 200))
        for _ in range(rng.randint(0, 2)):
            s, at = rng.choice(shared), rng.randint(0, len(text))
            text = text[:at] + s[rng.randint(0, 30) : len(s) - rng.randint(0, 90)] + text[at:]
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 1000), (105, "ab" * 400), (None, shared[0]), (106, "x" * 99), (107, shared[1][:100]), (108, shared[1][:100])]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE).repartition(5)
    assert found(suffix_dedup.remove_repeats(df)) == repeats_of(rows)


def test_repeats_with_crowds_in_workers(spark):
    """One passage in far more surroundings than one task may gather."""
    rng = random.Random(5)
    shared = prose(rng, 50)
    rows = [(i, f"{i:x} {rng.random()} {shared} {rng.random()} {i}") for i in range(2500)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE).repartition(3)
    assert found(suffix_dedup.remove_repeats(df)) == repeats_of(rows)


def test_repeats_in_long_text_and_empty_table(spark):
    rng = random.Random(7)
    text = prose(rng, 1000)
    long = "".join(rng.choice("abcdefgh") for _ in range((1 << 20) + 5000)) + text + "".join(rng.choice("xyzuvw") for _ in range(70_000))
    rows = [(1, long), (2, text)]
    assert found(suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE)))[1][2:4] == (len(text.encode()), 1)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SHAPE)).count() == 0


def test_suffix_order_is_sorted():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(24, 100))) for _ in range(400)]
    strings += [b"a" * n for n in range(30, 101)] * 2 + [b"a" * 60 + bytes([c]) for c in b"abc"]
    table = np.zeros((len(strings), 104), np.uint8)
    for i, s in enumerate(strings):
        table[i, : len(s)] = np.frombuffer(s, np.uint8)
    order = suffix_dedup.suffix_order(table, np.array([len(s) for s in strings]), np.zeros(len(strings), int))
    assert [strings[i] for i in order] == sorted(strings)


def components_of(fps, most=2):
    ids, label = list(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= most and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("block", [1024, 8])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    fps = {}
    for i in range(0, 240, 8):
        x = rng.getrandbits(64)
        for k in range(8):
            fps[i + k] = x
            for _ in range(rng.randint(0, 2)):
                x ^= 1 << rng.randrange(64)
    rows = {}
    for i, x in fps.items():
        rows.setdefault(x, i)
    distinct = {i: x for x, i in rows.items()}
    df = spark.createDataFrame([(x - (1 << 64) * (x >> 63), i) for i, x in distinct.items()], "fp long, rep long")
    from millrace.llm.components import connected_components

    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in connected_components(simhash.link_fingerprints(df, scratch), scratch).collect()}
    want = components_of(distinct)
    assert {i: got.get(i, i) for i in distinct} == want


def test_near_duplicates_edges(spark):
    rows = [(3, "a b c d"), (1, "A B  C\nD"), (7, None), (8, "  "), (9, ""), (None, "alone here now"), (4, "x y"), (4, "x y"), (5, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    of = {(i, c) for i, _, c in got}
    assert len(got) == len(rows) and {(3, 1), (1, 1), (7, 7), (8, 7), (9, 7), (4, 4), (5, 5), (None, None)} <= of
    assert all(f == 0 for i, f, _ in got if i in (7, 8, 9))
    kept = sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([1, 7, None, 4, 4, 5], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_simhash_by_definition():
    from xxhash import xxh64_intdigest

    text = "one two Three four two Three four"
    w = text.lower().split()
    hs = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.simhash("É B") == xxh64_intdigest("É b", 42)


def test_repeats_of_rows_that_share_an_id(spark):
    """Many null ids, rows of one id with different texts, and such whose texts' 16-bit hashes agree."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    shared = [prose(rng, 60) for _ in range(5)]
    rows = [(None, f"{prose(rng, rng.randint(0, 60))}{rng.choice(shared)}{i % 300}") for i in range(600)]
    some = spark.range(3000).select(F.concat(F.col("id").cast("string"), F.lit(" " + shared[0])).alias("t")).withColumn("h", F.xxhash64("t").bitwiseAND(F.lit(0xFFFF)))
    seen, clash = {}, None
    for r in some.collect():
        clash = clash or ((seen[r.h], r.t) if r.h in seen else None)
        seen[r.h] = r.t
    rows += [(5, clash[0]), (5, clash[1] + " and more"), (5, clash[1]), (5, clash[1]), (6, clash[0] + clash[1]), (6, clash[0] + clash[1])]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], SHAPE).repartition(4)
    assert found(suffix_dedup.remove_repeats(df)) == repeats_of(rows)


def test_repeats_when_hashes_collide(spark, monkeypatch):
    """Contents that hashes hold equal are compared by their bytes."""
    rng = random.Random(12)
    a, b = prose(rng, 80).encode(), prose(rng, 80).encode()
    data = np.frombuffer(a + b + a, np.uint8)
    x = {k: np.array(v, np.int64) for k, v in {"g": [7, 7, 7], "u": [9, 9, 9], "r": [1, 2, 3], "d": [1, 2, 3], "s": [0, 0, 0], "n": [20, 20, 20], "a": [30, 30, 30], "hot": [0, 0, 0], "p": [0, len(a), len(a) + len(b)]}.items()}
    got = [(r["kind"], r["rows"]) for out in suffix_dedup._ship(x, data, 4, 1, False) for r in out.to_pylist()]
    assert sorted(got) == [(0, 1), (1, 2)]

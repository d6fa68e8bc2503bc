"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random

import pytest

import corpus_pipeline
from millrace.llm import shingle_pairs

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """Ids that are the smallest of their component over pairs at 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return sorted(i for i in ids if top(i) == i)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("bucket, chunk", [(64, 1024), (3, 4)])
def test_stage_equals_brute_force(spark, monkeypatch, bucket, chunk):
    monkeypatch.setattr(shingle_pairs, "BUCKET", bucket)
    monkeypatch.setattr(shingle_pairs, "CHUNK", chunk)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(3, 250))) for _ in range(40)]
    texts += [edited(rng, t, k) for t in texts for k in (0, 1, 2, 3, 4, 5)]
    base = " ".join(rng.choices(WORDS, k=120))
    texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(90)]  # one large group
    passage = " ".join(rng.choices(WORDS, k=60))
    texts += [passage + " " + " ".join(rng.choices(WORDS, k=rng.randint(5, 40))) for _ in range(90)]
    texts += ["", "  \n", "A b", "a B", "x y z v w", "X y z v w u"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, (None, base), (7, texts[7])], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert None in got
    assert sorted({i for i in got if i is not None}) == kept(rows)


def test_empty_table(spark):
    assert corpus_pipeline.dedup_near(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_stage_equals_brute_force_in_cells(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "PAIRS", 2)
    test_stage_equals_brute_force(spark, monkeypatch, 64, 1024)


def test_sets_follow_links_not_common_shingles(spark, monkeypatch):
    """Texts that share a passage and are far from 0.8 are told apart before their sets are shuffled."""
    made, keep = [], shingle_pairs.Scratch.keep

    def kept_sets(self, df):
        out = keep(self, df)
        made.extend(r for r in out.collect() if out.columns[0] == "k" and out.dtypes[1][1] == "array<bigint>")
        return out

    monkeypatch.setattr(shingle_pairs.Scratch, "keep", kept_sets)
    monkeypatch.setattr(shingle_pairs, "SAMPLE", 1)  # so the passage is not known to be common
    rng = random.Random(6)
    passage = " ".join(rng.choices(WORDS, k=60))
    texts = [passage + " " + " ".join(rng.choices(WORDS, k=rng.randint(900, 1000))) for _ in range(80)]
    texts += [edited(rng, texts[0], 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").orderBy("doc_id").collect()] == list(range(80))
    assert len(made) == 2


def test_simhash_proposes_links(spark, monkeypatch):
    """SimHash alone finds near copies, and only those at 0.8 become links."""
    offered, alike = [], shingle_pairs._alike

    def noted(nodes, scratch):
        pairs = scratch.keep(alike(nodes, scratch))
        offered.extend(pairs.collect())
        return pairs

    monkeypatch.setattr(shingle_pairs, "_alike", noted)
    words = " ".join(f"u{i}" for i in range(2000))
    rows = [(1, words), (2, words + " end"), (3, "a b c d e"), (4, "a b c d e a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == kept(rows)
    assert offered


def test_picked_texts_alone_leave_the_join(spark):
    docs = spark.createDataFrame([*((i, f"t{i}") for i in range(1000)), (None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(7,), (8,), (7,), (None,)], "id long")
    rows = lambda how: shingle_pairs._listed(docs, ids, "doc_id", *how).collect()
    picked, others = rows([]), rows(["left_anti"])
    assert {7, 8} <= {r.doc_id for r in picked} and len(picked) < 10 and None not in {r.doc_id for r in picked}
    assert None in {r.doc_id for r in others} and len(picked) + len(others) == 1001


def test_each_verification_reads_the_texts_once(spark, monkeypatch, tmp_path):
    """Large buckets take more verifications, and each of them one pass over all texts, not two."""
    reads, sets, keep = [], [], shingle_pairs.Scratch.keep

    def noted(self, df):
        if any(str(tmp_path) in f for f in df.inputFiles()):
            (sets if df.columns == ["k", "x"] else reads).append(df.columns)
        return keep(self, df)

    monkeypatch.setattr(shingle_pairs.Scratch, "keep", noted)
    monkeypatch.setattr(shingle_pairs, "BUCKET", 3)
    monkeypatch.setattr(shingle_pairs, "CHUNK", 4)
    rng = random.Random(8)
    base = " ".join(rng.choices(WORDS, k=120))
    rows = list(enumerate([edited(rng, base, rng.randint(0, 4)) for _ in range(40)]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == kept(rows)
    assert len(sets) > 1
    assert [c[:2] for c in reads] == [["id", "k"]]

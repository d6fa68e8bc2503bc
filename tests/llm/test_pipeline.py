"""The pipeline on a small table against its stages redone by hand, and its stages on odd rows."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def near_groups(texts):
    """The smallest id that each reaches over five-word shingle sets at 0.8 or more: all pairs, by definition."""
    sets = {i: set(shingle_hashes(t, 5)) for i, t in texts.items()}
    label, ids = {i: i for i in sets}, sorted(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if not sets[a] and not sets[b] or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def lines_kept(texts):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\t\n\x0b\x0c\r "))
    holders = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])) for i, t in texts.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    frames = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        after.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or after.columns == docs.columns
        frames.append(after.toPandas())
        docs = after
    clean = set(labels[labels.toxic == 0].doc_id)
    source = pd.read_parquet(f"{SF}/documents.parquet")
    assert clean & set(source.doc_id) <= set(frames[0].doc_id) and len(frames[0]) < len(source)
    assert dict(zip(frames[1].doc_id, frames[1].text, strict=True)) == lines_kept(dict(zip(frames[0].doc_id, frames[0].text, strict=True)))
    assert (frames[1].text.str.len() == frames[1].n_chars).all()
    group = near_groups(dict(zip(frames[1].doc_id, frames[1].text, strict=True)))
    assert set(frames[2].doc_id) == set(group.values())
    assert set(frames[3].doc_id) <= set(frames[2].doc_id)
    assert set(frames[4].doc_id) == set(frames[3].doc_id)
    assert frames[4].groupby("sequence_id").length.sum().max() <= 1024
    assert corpus_pipeline.run(spark, SF).count() == len(frames[4])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as those that operators add."""
    line = "The same long line that a good many documents share, word for word"
    rows = [(i, f"own words of number {i} are here {'x' * i}\n{line}", "en", "a", 0) for i in range(8)]
    rows += [(20, None, None, None, None), (21, "", "en", "b", 0), (22, "  \n ", "en", "b", 3), (None, line, "en", "a", 1), (None, None, None, None, None)]
    rows += [(23, "word " * 60_000, "en", "c", 0), (24, "same text in two rows, five words at least", "en", "a", 0), (24, "same text in two rows, five words at least", "en", "a", 0), (25, "Same  text in two rows, five words at LEAST", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("p_toxic", "p_quality", "n_lines", "n_dropped", "mix_weight", "mix_key", "fp", "component_id", "size", "members", "id", "k", "n", "h"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.mark.parametrize("at", range(5))
def test_stage_on_odd_rows(spark, odd, at):
    _, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, SF)
    got = out.collect()
    assert stage(spark, odd.where("false"), SF).count() == 0
    if at == 4:
        assert len({(r.sequence_id, r.offset) for r in got}) == len(got) >= odd.count() and sum(r.doc_id is None for r in got) == 2
        return
    assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in got for c in odd.columns[5:])
    ids = sorted((r.doc_id for r in got), key=lambda i: (i is None, i))
    all_ids = sorted((r.doc_id for r in odd.select("doc_id").collect()), key=lambda i: (i is None, i))
    if at == 1:
        assert ids == all_ids and all(r.n_chars == len(r.text) for r in got)
        assert [r.text.count("\n") for r in sorted((r for r in got if (r.doc_id if r.doc_id is not None else 9) < 8), key=lambda r: r.doc_id)] == [0] * 7 + [1]
    elif at == 2:
        assert ids == [*range(8), 20, 23, 24, 24, None, None]
    elif at == 3:  # 23 alone has more words than the weight of its source allows
        assert set(ids) == set(all_ids) - {23}
    else:
        assert set(ids) == set(all_ids)

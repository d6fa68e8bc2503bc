"""Toxicity by classifier chains: linear models in sequence, each fed the earlier ones' probabilities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.scratch import Scratch

#: Labelled rows that a chain is fitted on at most, chosen by a hash of their id.
SAMPLE = 6_000
#: Words and beginnings of words that each link of the chain may use.
TERMS = 256
FOLDS = 5
#: Bytes of words' beginnings that are terms beside the words: inflected forms of a word share one.
STEMS = (4, 5, 6, 7, 8)
#: Rows of the sample that must have a term for it to count.
LEAST = 3
#: Chi-square that a term must exceed; high, as there are many thousands of terms to choose from.
SIGNIFICANT = 20.0
#: Texts that are scored at once.
BATCH = 1_000
#: Penalty of the weights.
RIDGE = 0.3
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """A text's distinct words: A-Z lower-cased, ASCII marks as separators."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())


def beginnings(found: set[bytes], length: int) -> set[bytes]:
    """The first bytes of words that have as many, marked by a star, which no word holds."""
    return {w[:length] + b"*" for w in found if len(w) >= length}


@dataclass
class Link:
    """A logistic model over the presence of some words and the probabilities of the links before it."""

    terms: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # intercept, earlier links, terms

    def odds(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.weights[0] + before @ self.weights[1 : 1 + before.shape[1]] + x @ self.weights[1 + before.shape[1] :]


@dataclass
class Chain:
    categories: list[str]
    links: list[Link]
    _whole: set[bytes] | None = None
    _begun: list[tuple[int, set[bytes]]] = field(default_factory=list)

    def known(self, text: str | None) -> set[bytes]:
        """The chain's terms that a text has."""
        if self._whole is None:
            every = {t for link in self.links for t in link.terms}
            self._whole = {t for t in every if t[-1:] != b"*"}
            self._begun = [(n, s) for n in STEMS if (s := {t[:-1] for t in every if t[-1:] == b"*" and len(t) == n + 1})]
        found = words(text)
        out = self._whole & found
        for n, begun in self._begun:  # a shorter word's first n bytes are shorter, too, so never there
            out.update(b + b"*" for b in begun.intersection([w[:n] for w in found]))
        return out

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        found = [self.known(t) for t in texts]
        before = np.zeros((len(found), 0))
        for link in self.links:
            at = {w: i for i, w in enumerate(link.terms)}
            x = np.zeros((len(found), len(at)))
            for i, ws in enumerate(found):
                x[i, [at[w] for w in at.keys() & ws]] = 1
            before = np.c_[before, _probability(link.odds(x, before))]
        return before


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge-penalised logistic regression; column 0 is the intercept, not penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-4
    for _ in range(15):
        p = _probability(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit_link(rows: np.ndarray, codes: np.ndarray, names: list[bytes], y: np.ndarray, before: np.ndarray, train: np.ndarray, terms: int) -> tuple[Link, np.ndarray]:
    """Fits on the rows of the mask train; returns the link and its probabilities on all rows.
    (rows, codes): one entry for each distinct word of each row."""
    n, inside = len(y), train[rows]
    pos = np.bincount(codes[inside & y[rows]], minlength=len(names)).astype(float)
    every = np.bincount(codes[inside], minlength=len(names)).astype(float)
    a, b = (train & y).sum(), train.sum()
    if not 0 < a < b:
        link = Link([], np.r_[-30.0 if not a else 30.0, np.zeros(before.shape[1])])
        return link, _probability(np.full(n, link.weights[0]))
    want = every * a / b
    chi = np.where(every > 1, (pos - want) ** 2 / np.maximum(want * (1 - a / b) * (1 - every / (b + 1)), 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:terms]
    best = best[chi[best] > SIGNIFICANT]
    at = np.full(len(names), -1)
    at[best] = np.arange(len(best))
    x = np.zeros((n, len(best)))
    use = at[codes] >= 0
    x[rows[use], at[codes[use]]] = 1
    full = np.c_[np.ones(n), before, x]
    link = Link([names[i] for i in best], _newton(full[train], y[train].astype(float)))
    return link, _probability(full @ link.weights)


def terms_of(text: str | None) -> set[bytes]:
    found = words(text)
    return found.union(*(beginnings(found, n) for n in STEMS))


def significant_terms(sample: DataFrame, sizes: np.ndarray, categories: int) -> list[bytes]:
    """Terms that LEAST rows have and that exceed SIGNIFICANT for some category on some training set: all
    rows, or all but one fold. sample: text, fold, bits (category i is bit i); sizes: rows by fold and bits.

    Each task counts the terms of its rows by fold and bits; only the sums of a term decide on it.
    """
    folds, classes = sizes.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for c, seen in held.items():
                fold, bits = divmod(c, classes)
                n = len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([fold] * n, pa.int32()), pa.array([bits] * n, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "fold", "bits", "n"])
            held.clear()

        for batch in batches:
            for text, fold, bits in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(fold * classes + bits, Counter()).update(terms_of(text.as_py()))
                if sum(map(len, held.values())) > 200_000:
                    yield from flush()
        yield from flush()

    seen = sample.select("text", "fold", "bits").mapInArrow(count, "term binary, fold int, bits int, n long")
    own = lambda fold, what=F.lit(True): F.sum(F.when((F.col("fold") == fold) & what, F.col("n")).otherwise(0))
    has = lambda c: F.col("bits").bitwiseAND(F.lit(1 << c)) != 0
    sums = seen.groupBy("term").agg(F.sum("n").alias("all"), *(own(f).alias(f"n{f}") for f in range(folds)), *(own(f, has(c)).alias(f"p{c}_{f}") for f in range(folds) for c in range(categories))).where(F.col("all") >= LEAST)
    exceeds = F.lit(False)
    for out in (None, *range(folds)):
        inside = [f for f in range(folds) if f != out]
        b = float(sizes[inside].sum())
        every = sum((F.col(f"n{f}") for f in inside), F.lit(0))
        for c in range(categories):
            a = float(sizes[inside][:, [k for k in range(classes) if k >> c & 1]].sum())
            if 0 < a < b:
                want, pos = every * (a / b), sum((F.col(f"p{c}_{f}") for f in inside), F.lit(0))
                chi = (pos - want) * (pos - want) / F.greatest(want * (1 - a / b) * (1 - every / (b + 1)), F.lit(1e-9))
                exceeds = exceeds | ((every > 1) & (chi > SIGNIFICANT))
    return sorted(bytes(t) for t in sums.where(exceeds).select("term").toArrow()["term"].to_pylist())


def fit_chain(texts: DataFrame, categories: Sequence[str], text_col: str = "text", id_col: str = "doc_id", terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """texts: labelled rows, a bounded sample, with 0/1 columns named by categories (null: 0).

    Each link is fitted on all rows; what the next links see of it for training comes from models
    that did not see the row, one for each fold, so that they learn how far to trust it. The driver
    gets the significant terms and the rows' places among these, no texts.
    """
    y = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in categories]
    bits = sum((F.when(v != 0, 1 << i).otherwise(0) for i, v in enumerate(y)), F.lit(0))
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(1)), F.lit(folds)).cast("int")
    sample = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), fold.alias("fold"), bits.cast("int").alias("bits"))
    sizes = np.zeros((folds, 1 << len(categories)), dtype=np.int64)
    for r in sample.groupBy("fold", "bits").agg(F.count("*").alias("n")).collect():
        sizes[r.fold, r.bits] = r.n
    names = significant_terms(sample, sizes, len(categories))
    at = {t: i for i, t in enumerate(names)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[at[t] for t in terms_of(text.as_py()) & at.keys()] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fold"), batch.column("bits"), pa.array(found, pa.list_(pa.int32()))], names=["id", "fold", "bits", "terms"])

    got = sample.mapInArrow(places, "id long, fold int, bits int, terms array<int>").toPandas().sort_values("id", kind="stable")
    n, fold_, bits_ = len(got), got["fold"].to_numpy(), got["bits"].to_numpy()
    lengths = np.array([len(t) for t in got["terms"]], dtype=np.int64)
    rows = np.repeat(np.arange(n), lengths)
    codes = np.concatenate([np.asarray(t, dtype=np.int64) for t in got["terms"]]) if n else np.zeros(0, dtype=np.int64)
    before, links = np.zeros((n, 0)), []
    for i in range(len(categories)):
        y_ = (bits_ >> i & 1).astype(bool)
        link, _ = _fit_link(rows, codes, names, y_, before, np.ones(n, dtype=bool), terms)
        links.append(link)
        if i + 1 < len(categories):
            unseen = np.zeros(n)
            for k in range(folds):
                _, p = _fit_link(rows, codes, names, y_, before, fold_ != k, terms)
                unseen[fold_ == k] = p[fold_ == k]
            before = np.c_[before, unseen]
    return Chain(list(categories), links)


def labelled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `sample` labelled documents, chosen by a hash of the id: (id, text, categories). Rows that repeat an
    id are one document, with the least of their texts. The sample is broadcast to the documents: `sample` rows of
    some numbers, whatever the input."""
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(c).alias(f"__y{i}") for i, c in enumerate(categories)))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    one = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col)
    return one.groupBy(id_col).agg(F.min(text_col).alias(text_col), *(F.max(f"__y{i}").alias(c) for i, c in enumerate(categories)))


def with_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), train_docs: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a double column p_<category> for each category, predicted in the given order.

    The chain is fitted on at most `sample` labelled rows of train_docs (docs if not given), whole
    texts; the model, at most TERMS words and beginnings of words for each category, goes to the executors and every row is
    scored by its whole text. Null or empty text: no words. Null ids are scored, never trained on.
    Repeated rows are scored alike; an id labelled more than once counts as labelled if any row says
    so. No labels, or one class only: that class's probability. Empty docs: no rows. Columns named
    p_<category> are replaced.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = scratch.keep(labelled(docs if train_docs is None else train_docs, labels, categories, sample, id_col, text_col))
    chain = fit_chain(own, categories, text_col, id_col)
    scratch.drop(own)
    kind = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in categories])

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        some = [chain.probabilities(texts.iloc[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
        return pd.DataFrame(np.concatenate(some) if some else np.zeros((0, len(categories))), columns=[f"p_{c}" for c in categories])

    drop = [f"p_{c}" for c in categories]
    scored = docs.drop(*drop).withColumn("__p", score(F.col(text_col)))
    return scored.select(*docs.drop(*drop).columns, *(F.col("__p")[c].alias(c) for c in drop))

"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

#: Hex digits of a document's key that make its bucket within the source.
_DIGITS = 3
#: Each pass over the sources tries so many exponents, which halves the interval five times.
_TRIED = 32


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(id_col: Column, round_: Column) -> Column:
    """A document's place in a pass over its source: the md5 of id and pass, as hex digits."""
    return F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), round_.cast("string")))


def temper(sources: DataFrame, budget: float | None, entropy: float, max_repeats: float) -> tuple[float, float]:
    """The exponent in [0, 1] for source shares, and the sum of the shares to that power.

    Flatter weights (a smaller exponent) have more entropy and repeat small sources more. Wanted is
    the largest exponent whose weights have at least `entropy` times the largest entropy, but none so
    small that a source repeats more than max_repeats times; the latter wins. Bisection to 2^-20.
    sources: (share, n_all) of the sources that have tokens; only sums over them reach the driver.
    """

    def tried(points: list[float]) -> dict[float, tuple[float, float, float]]:
        x = sources.select("share", F.explode(F.array(*map(F.lit, points))).alias("x")).withColumn("q", F.pow("share", F.col("x")))
        rows = x.groupBy("x").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("x") * F.log("share")).alias("e"), F.max(F.col("q") / F.col("share")).alias("r")).collect()
        return {r.x: (math.log(r.z) - r.e / r.z, budget * r.r / r.z, r.z) for r in rows}

    n = sources.count()
    if not n:
        return 1.0, 1.0
    floor = entropy * math.log(n)

    def largest(good) -> float:
        """The largest exponent, to 2^-20, that is good; good holds up to some exponent. 0 if none."""
        low, step = 0.0, 1.0
        for _ in range(4):
            step /= _TRIED
            got = tried([low + step * i for i in range(1, _TRIED + 1) if low + step * i <= 1])
            held = [x for x, v in got.items() if good(v)]
            low = max(held, default=low)
        return low

    by_entropy = largest(lambda v: v[0] >= floor)
    by_repeats = largest(lambda v: v[1] > max_repeats)
    x = max(by_entropy, min(1.0, by_repeats + 2.0**-20) if tried([by_entropy])[by_entropy][1] > max_repeats else 0.0)
    return x, tried([x])[x][2]


def mix(docs: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs once for each pass that takes them, with mix_weight (the source's), mix_pass (from 0) and
    mix_key, the place in the pass (ascending).

    A source's share of all words (runs of anything but ASCII white space) is raised to the exponent
    that temper() finds, and normalised. Its weight times the budget (default: all words) is its
    number of words, rounded. As many whole passes over the source as fit are taken, and of the next
    pass the documents in the order of mix_key, up to the last with which the words still fit. Each pass has
    an order of its own.

    Null source: a source of its own. Null or empty text: no words, so taken in each pass that is
    whole, and in a last pass by its place. A source without words is taken once. Rows that repeat an
    id have the same place and are taken together. Empty table: no rows. Columns named mix_* are
    replaced.

    Running sums go over 4096 buckets of keys of each source, then over the documents of the one
    bucket that the budget ends in, so no window holds a whole source. The texts are not shuffled:
    what is decided is one cut for each source, joined back by source as Spark sees fit (by
    broadcast only where the table is below the session's limit).
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = [c for c in docs.columns if c not in ("mix_weight", "mix_pass", "mix_key")]
    docs = docs.select(*own)
    size = scratch.keep(docs.select(F.col(source_col).alias("s"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("n")))
    sources = size.groupBy("s").agg(F.sum("n").alias("own"))
    total = sources.agg(F.sum("own")).first()[0] or 0
    budget = total if budget is None else budget
    shares = scratch.keep(sources.where("own > 0").select("s", "own", (F.col("own") / F.lit(float(max(total, 1)))).alias("share")))
    x, z = temper(shares.select("share"), budget / max(total, 1), entropy, max_repeats)
    weight = F.pow("share", F.lit(x)) / F.lit(z)
    plan = shares.select("s", "own", weight.alias("weight"), F.floor(weight * F.lit(float(budget)) + 0.5).cast("long").alias("due"))
    plan = plan.select("s", "weight", F.floor(F.col("due") / F.col("own")).cast("long").alias("whole"), (F.col("due") % F.col("own")).alias("rest"))
    plan = scratch.keep(plan)
    same = lambda a, b: a.eqNullSafe(b)
    p = plan.withColumnRenamed("s", "ps")
    keyed = size.join(p, same(F.col("s"), F.col("ps"))).select("s", "n", "rest", order_key(F.col("id"), F.col("whole")).alias("key"))
    bucket = F.substring("key", 1, _DIGITS)
    sums = keyed.groupBy("s", "rest", bucket.alias("b")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("b"))
    last = sums.select("s", "b", "rest", "n", upto.alias("upto")).where("upto > rest")
    last = last.groupBy("s").agg(F.min(F.struct("b", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("l")).select(F.col("s").alias("ls"), "l.b", "l.left")
    last = scratch.keep(last)
    inside = keyed.join(last, same(F.col("s"), F.col("ls")) & (bucket == F.col("b")))
    fits = inside.select("ls", "b", "key", "left", F.sum("n").over(Window.partitionBy("ls").orderBy("key")).alias("upto"))
    cut = fits.groupBy("ls", "b").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("key"))).alias("key")).select("ls", F.coalesce("key", "b").alias("cut"))
    plan = scratch.keep(plan.join(cut, same(F.col("s"), F.col("ls")), "left").select(F.col("s").alias("__s"), F.col("weight").alias("__w"), F.col("whole").alias("__whole"), F.coalesce("cut", F.lit("")).alias("__cut")))
    out = docs.join(plan, same(F.col(source_col), F.col("__s")), "left")
    whole = F.coalesce("__whole", F.lit(1))
    more = (order_key(F.col(id_col), F.col("__whole")) <= F.col("__cut")).cast("int")
    passes = F.sequence(F.lit(0), (whole + F.coalesce(more, F.lit(0)) - 1).cast("int"))
    some = whole + F.coalesce(more, F.lit(0)) > 0
    out = out.where(some).select(*own, F.coalesce("__w", F.lit(0.0)).alias("mix_weight"), F.explode(passes).alias("mix_pass"))
    return out.withColumn("mix_key", order_key(F.col(id_col), F.col("mix_pass")))

"""Tests and intervals by resampling, at full numbers of draws.

A draw's statistic depends only on how often each value is drawn, so equal values are counted first and
a whole draw is a vector of counts: binomial for sign flips, multinomial for the bootstrap, multivariate
hypergeometric for permutations. Distinct values are dealt into chunks by a hash. The number of rows to
draw is split over the chunks first, each draw's in one piece of work; a task then draws within its chunk
and returns one sum for each draw. Rows times draws are never written out. The same seed gives the
same draws, however Spark divides the work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.operators.rounds import written

#: Distinct values in a chunk, and how many draws' counts a task holds at a time.
CHUNK, BLOCK = 512, 512
_SUMS = "sums array<double>"


def counted(rows: DataFrame, value: str, *more: Column) -> tuple[DataFrame, int]:
    """(chunk, v, m: how often value occurs, more aggregates), without nulls; and the number of chunks."""
    values = rows.where(F.col(value).isNotNull()).groupBy((F.col(value).cast("double") + 0.0).alias("v")).agg(F.count("*").alias("m"), *more)
    values = written(values)
    chunks = max(1, -(-values.count() // CHUNK))
    return values.withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int")), chunks


def _signs(rng: np.random.Generator, m: np.ndarray, draws: int) -> np.ndarray:
    """For each draw the sum of m random signs of every value."""
    out = np.empty((draws, len(m)))
    alone = m == 1
    out[:, alone] = 2.0 * rng.integers(0, 2, (draws, alone.sum()), dtype=np.uint8) - 1
    out[:, ~alone] = 2.0 * rng.binomial(m[~alone], 0.5, (draws, (~alone).sum())) - m[~alone]
    return out


def _per_draw(sums: DataFrame) -> DataFrame:
    """(draw, s): the chunks' sums, added up."""
    return sums.select(F.posexplode("sums").alias("draw", "s")).groupBy("draw").agg(F.sum("s").alias("s"))


def sign_flip_p(diffs: DataFrame, draws: int = 20_000, seed: int = 0, value: str = "d") -> DataFrame:
    """One row (observed, p_value): the mean difference and the share of draws, each with random signs,
    whose mean is as far from 0 or farther; add-one smoothing. Without rows null and 1."""
    values, _ = counted(diffs.select(F.col(value).alias("d")), "d")

    def flip(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("v")
        rng, v, m = np.random.default_rng([seed, int(key[0])]), t["v"].to_numpy(), t["m"].to_numpy()
        parts = [_signs(rng, m, min(BLOCK, draws - k)) @ v for k in range(0, draws, BLOCK)]
        return pd.DataFrame({"sums": [np.concatenate(parts)]})

    each = _per_draw(values.groupBy("chunk").applyInPandas(flip, _SUMS))
    whole = values.agg(F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("total"), F.sum(F.abs("v") * F.col("m")).alias("size"))
    as_far = F.abs("s") >= F.abs("total") - 1e-12 * F.col("size")
    ranked = each.join(F.broadcast(whole)).agg(F.sum(as_far.cast("long")).alias("k"))  # one row each
    return whole.join(ranked).select((F.col("total") / F.col("n")).alias("observed"), F.when(F.col("n") > 0, (F.coalesce("k", F.lit(0)) + 1) / (draws + 1)).otherwise(1.0).alias("p_value"))


def _shares(values: DataFrame, draws: int, seed: int, split) -> DataFrame:
    """(chunk, first, shares): of the draws from `first` on, how many rows fall to each chunk; split(rng, sizes, draws)
    makes a row for each draw."""
    sizes = written(values.groupBy("chunk").agg(F.sum("m").alias("size")))
    blocks = values.sparkSession.range(0, draws, BLOCK).toDF("first")

    def divide(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("chunk")
        rng, first = np.random.default_rng([seed, 1, int(key[0])]), int(key[0])
        counts = split(rng, t["size"].to_numpy(), min(BLOCK, draws - first))
        return pd.DataFrame({"chunk": t["chunk"], "first": first, "shares": list(counts.T.astype(np.int64))})

    # every block of draws needs every chunk's size: a row for each of both
    return blocks.join(F.broadcast(sizes)).groupBy("first").applyInPandas(divide, "chunk int, first long, shares array<bigint>")


def _drawn(values: DataFrame, shares: DataFrame, draws: int, seed: int, within) -> DataFrame:
    """(draw, s) of draws that take shares of each chunk; within(rng, v, m, share) is one draw's sum there."""

    def take(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("v"), right.sort_values("first")
        rng, v, m = np.random.default_rng([seed, 2, int(key[0])]), left["v"].to_numpy(), left["m"].to_numpy()
        return pd.DataFrame({"sums": [np.array([within(rng, v, m, int(k)) for k in np.concatenate(right["shares"].to_list())])]})

    return _per_draw(values.groupBy("chunk").cogroup(shares.groupBy("chunk")).applyInPandas(take, _SUMS))


def bootstrap_ci(diffs: DataFrame, draws: int = 10_000, seed: int = 0, value: str = "d") -> DataFrame:
    """One row (low, high): the 95 % percentile interval of the mean, each draw taking as many rows as there are, with
    replacement: the values at places floor(0.025 * draws) and floor(0.975 * draws), from 0, of the sorted
    means. Without rows 0 and 0."""
    values, _ = counted(diffs.select(F.col(value).alias("d")), "d")
    shares = _shares(values, draws, seed, lambda rng, sizes, k: rng.multinomial(int(sizes.sum()), sizes / sizes.sum(), k))
    each = _drawn(values, shares, draws, seed, lambda rng, v, m, k: float(rng.multinomial(k, m / m.sum()) @ v))
    n = values.agg(F.sum("m").alias("n"))
    means = each.join(F.broadcast(n)).agg(F.array_sort(F.collect_list(F.col("s") / F.col("n"))).alias("means"))  # a number for each draw
    at = lambda p: F.coalesce(F.get("means", F.lit(int(p * draws))), F.lit(0.0))
    return means.select(at(0.025).alias("low"), at(0.975).alias("high"))


def _subset(rng: np.random.Generator, m: np.ndarray, k: int) -> np.ndarray:
    return rng.multivariate_hypergeometric(m, k, method="marginals")


def correlation_p(rows: DataFrame, x: str, y: str, draws: int = 20_000, seed: int = 0) -> DataFrame:
    """One row (r, p_value): Pearson's r of x with a 0/1 outcome y, 0 where a variance is 0, and the share of permutations of y
    whose r is as far from 0 or farther; add-one smoothing. r depends on the sum of x over the ones, and
    a permutation deals exactly as many ones as there are. Rows with a null are left out; up to 10**9 rows."""
    usable = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), (F.col(y) != 0).cast("long").alias("y"))
    values, _ = counted(usable, "x", F.sum("y").alias("ones"))
    v, m = F.col("v"), F.col("m")
    whole = values.agg(F.sum("m").alias("n"), F.sum("ones").alias("k"), F.sum(v * m).alias("sx"), F.sum(v * F.col("ones")).alias("s1"), F.max("v").alias("high"), F.min("v").alias("low"))
    whole = written(whole)
    facts = whole.first()
    n, k = int(facts["n"] or 0), int(facts["k"] or 0)
    spread = n and facts["high"] > facts["low"] and 0 < k < n
    if not spread:
        return whole.select(F.lit(0.0).alias("r"), F.lit(1.0).alias("p_value"))
    mean = facts["sx"] / n
    var = values.agg(F.sum(m * (v - mean) * (v - mean)).alias("ss"))
    shares = _shares(values, draws, seed, lambda rng, sizes, d: rng.multivariate_hypergeometric(sizes, k, d, method="marginals"))
    each = _drawn(values, shares, draws, seed, lambda rng, v, m, share: float(_subset(rng, m, share) @ v))
    gap = lambda s: F.abs(F.col(s) - k * mean)  # noqa: E731  r is this over a constant
    ranked = each.join(F.broadcast(whole.select("s1"))).agg(F.sum((gap("s") >= gap("s1") - 1e-12 * (abs(k * mean) + 1)).cast("long")).alias("as_far"))
    r = (F.col("s1") - k * mean) / F.sqrt(F.col("ss") * (k * (n - k) / n))
    return whole.join(var).join(ranked).select(r.alias("r"), ((F.col("as_far") + 1) / (draws + 1)).alias("p_value"))  # one row each

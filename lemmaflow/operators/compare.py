"""Comparisons of methods on shared problems: head to head, paired tests, correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.operators.metrics import nearest_rank


def head_to_head(hits: DataFrame, ours: int, base: int, hit: str = "complete_hit") -> DataFrame:
    """Wins, losses, both, neither and win rate (null without a decided problem) of two methods over
    the same denominator; hits has a row for each group and method. One pass, no join."""
    one = lambda m: F.max(F.when(F.col("method") == m, F.col(hit)).otherwise(0))
    pairs = hits.where(F.col("method").isin(ours, base)).groupBy("group_id").agg(one(ours).alias("a"), one(base).alias("b"))
    count = lambda a, b: F.sum(((F.col("a") == a) & (F.col("b") == b)).cast("long"))
    out = pairs.agg(F.count("*").alias("problems"), count(1, 0).alias("wins"), count(0, 1).alias("losses"), count(1, 1).alias("both"), count(0, 0).alias("neither"))
    decided = F.col("wins") + F.col("losses")
    return out.withColumn("win_rate", F.when(decided > 0, F.col("wins") / decided))


def mcnemar_p(n10: Column, n01: Column) -> Column:
    """Two-sided exact McNemar test of the discordant counts: twice the lower binomial tail, 1 at most. The tail's
    largest term is taken out, as a logarithm, so any counts will do; terms fall from there."""
    n, k = n10 + n01, F.least(n10, n01)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_choose = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def lower(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    tail = F.aggregate(steps, start, lower, lambda s: s["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail * F.exp(log_choose - n * math.log(2)))).otherwise(1.0)


def mcnemar(table: DataFrame) -> DataFrame:
    """head_to_head rows with p_value; wins and losses are the discordant counts."""
    return table.withColumn("p_value", mcnemar_p(F.col("wins"), F.col("losses")))


def paired_density(problems: DataFrame, a: int, b: int, density: str = "semantic_density") -> DataFrame:
    """Wins, losses, ties and mean difference of two methods' densities on the problems both have."""
    own = lambda m, n: problems.where(F.col("method") == m).select("problem_id", F.col(density).alias(n))
    d = own(a, "x").join(own(b, "y"), "problem_id").withColumn("d", F.col("x") - F.col("y"))
    sign = lambda c: F.sum(c.cast("long"))
    return d.agg(F.count("*").alias("problems"), sign(F.col("d") > 0).alias("wins"), sign(F.col("d") < 0).alias("losses"), sign(F.col("d") == 0).alias("ties"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg("d").alias("mean_difference"))


def paired_report(problems: DataFrame, a: int, b: int, density: str = "semantic_density") -> DataFrame:
    """Three rows, of side a, b and difference, over the problems both methods have: n, mean, nearest-rank quantiles p25, p50, p75, p90 and, for
    the difference, wins, losses and ties; its p50 is the upper middle value. No rows without shared problems."""
    own = lambda m, n: problems.where(F.col("method") == m).select("problem_id", F.col(density).cast("double").alias(n))
    pairs = own(a, "a").join(own(b, "b"), "problem_id").where("a is not null and b is not null").withColumn("difference", F.col("a") - F.col("b"))
    long = pairs.unpivot(["problem_id"], ["a", "b", "difference"], "side", "x")
    points = nearest_rank(long, ["side"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    signs = [F.sum(F.when(F.col("side") == "difference", c.cast("long"))).alias(n) for n, c in (("wins", F.col("x") > 0), ("losses", F.col("x") < 0), ("ties", F.col("x") == 0))]
    ordered = _upper_middle(long.where("side = 'difference'"), "x")
    out = long.groupBy("side").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), *signs).join(points, "side").join(ordered, "side", "left")
    return out.withColumn("p50", F.coalesce("_middle", "p50")).drop("_middle")


def _upper_middle(rows: DataFrame, value: str) -> DataFrame:
    """(side, _middle): the value at place n div 2, from 0; equal values are counted first."""
    counts = rows.groupBy("side", value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("side")
    ranked = counts.withColumns({"_z": F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    return ranked.where((F.floor(F.col("_n") / 2) < F.col("_z")) & (F.floor(F.col("_n") / 2) >= F.col("_z") - F.col("_c"))).select("side", F.col(value).alias("_middle"))


def _correlation(x: str, y: str) -> Column:
    """Pearson r, 0 where a variance is 0 or there are no rows (corr itself fails there in ANSI mode)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread).otherwise(0.0)


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r (0 where a variance is 0), and the mean of x by outcome."""
    return rows.agg(_correlation(x, y).alias("r"), F.avg(F.when(F.col(y) == 1, F.col(x))).alias("mean_if_1"), F.avg(F.when(F.col(y) == 0, F.col(x))).alias("mean_if_0"))


def subset_density(counts: DataFrame, subset: DataFrame, passed: str = "passes", tried: str = "attempts") -> DataFrame:
    """Per method: problems of the subset with attempts, and the mean of passed / tried over them.
    counts: a row for each group_id and method; subset: (group_id)."""
    rows = counts.join(subset.select("group_id").distinct(), "group_id", "left_semi").where(F.col(tried) > 0)
    return rows.groupBy("method").agg(F.count("*").alias("problems"), F.avg(F.col(passed) / F.col(tried)).alias("density"))


def common_correct(counts: DataFrame, a: int, b: int, passed: str = "passes", tried: str = "attempts") -> DataFrame:
    """One row: problems that both methods tried and solved, mean densities on them and their
    difference; nulls where there are none."""
    own = lambda m, n: F.max(F.when((F.col("method") == m) & (F.col(passed) > 0) & (F.col(tried) > 0), F.col(passed) / F.col(tried))).alias(n)
    both = counts.where(F.col("method").isin(a, b)).groupBy("group_id").agg(own(a, "x"), own(b, "y")).where("x is not null and y is not null")
    return both.agg(F.count("*").alias("problems"), F.avg("x").alias("density_a"), F.avg("y").alias("density_b"), F.avg(F.col("x") - F.col("y")).alias("difference"))

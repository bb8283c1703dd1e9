"""Populations of candidates: total order, parents, inspirations, draws, bandit state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_metric(metrics: Column) -> Column:
    """Mean of the numbers in a metrics JSON object; null without any."""
    values = F.map_values(F.from_json(metrics, "map<string,double>"))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def better_first() -> list[Column]:
    """The order "better": correct, score (nulls last), mean metric, newer; ties by id."""
    return [F.desc("compile_ok"), F.desc_nulls_last("combined_score"), F.desc_nulls_last(mean_metric(F.col("public_metrics"))), F.desc("ts"), F.col("id")]


def best_overall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each key in that order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*better_first()))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def island_sizes(programs: DataFrame) -> DataFrame:
    return programs.where("island_idx is not null").groupBy("island_idx").agg(F.count("*").alias("population"))


def parent_pairs(children: DataFrame, keys: list[str], a: str, b: str, most: int = 3) -> DataFrame:
    """The most frequent unordered parent pairs of each key, and how many different ones there are."""
    pair = children.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    counts = pair.groupBy(*keys, "low", "high").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "low", "high")), "pairs": F.count("*").over(w)})
    return ranked.where(F.col("rank") <= most)


def every_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows at which a counter of the rows of a key reaches another n."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("count", i).where(F.col("count") % n == 0)


def _normalised(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_w", weight)
    return rows.withColumn("probability", F.when(F.sum("_w").over(w) > 0, F.col("_w") / F.sum("_w").over(w)).otherwise(1 / F.count("*").over(w))).drop("_w")


def cycle_softmax(rows: DataFrame, keys: list[str], log_prob: str, children: str, temperature: float = 3.5, alpha: float = 0.05) -> DataFrame:
    """Selection probability by softmax of log-probability over temperature, less log(1 + alpha *
    children). Rows without a log-probability get none, unless a key has no other rows: then all
    are equally likely."""
    w = Window.partitionBy(*keys)
    logit = F.col(log_prob) / max(temperature, 1e-6) - F.log(1 + max(alpha, 0.0) * F.greatest(F.coalesce(children, F.lit(0)), F.lit(0)))
    rows = rows.withColumn("_x", logit)
    return _normalised(rows, keys, F.coalesce(F.exp(F.col("_x") - F.max("_x").over(w)), F.lit(0.0))).drop("_x")


def archive_weights(rows: DataFrame, keys: list[str], reward: str, usage: str, order: list[str], top: int = 10, alpha: float = 3.0, beta: float = 0.3) -> DataFrame:
    """First-parent probability among each key's `top` rows by reward: exp(alpha * reward / largest)
    times exp(-beta * usage)."""
    w = Window.partitionBy(*keys)
    best = rows.withColumn("_k", F.row_number().over(w.orderBy(F.desc(reward), *order))).where(F.col("_k") <= top).drop("_k")
    most = F.max(reward).over(w)
    share = F.when(most > 0, F.col(reward) / most).otherwise(0.0)
    return _normalised(best.withColumn("_s", share), keys, F.exp(alpha * F.col("_s")) * F.exp(-beta * F.col(usage))).drop("_s")


def hash_uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that follows from seed and columns, so that reruns agree."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**52)) + 0.5) / float(2**52)


def draw(rows: DataFrame, keys: list[str], probability: str, n: int, seed: int, ident: str = "id") -> DataFrame:
    """n rows of each key without replacement, by their probabilities: the smallest -ln(u) / p."""
    turn = -F.log(hash_uniform(seed, ident)) / F.col(probability)
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("_t", ident))
    return rows.where(F.col(probability) > 0).withColumn("_t", turn).withColumn("draw", k).where(F.col("draw") <= n).drop("_t")


def second_parents(rows: DataFrame, first: DataFrame, keys: list[str], reward: str, seed: int) -> DataFrame:
    """One second parent for each first one (keys, id): uniform among others with a reward above 0;
    if there are none, among all others."""
    others = rows.join(first.select(*keys, F.col("id").alias("first_id")), keys).where("id <> first_id")
    k = F.row_number().over(Window.partitionBy(*keys, "first_id").orderBy(F.desc(F.col(reward) > 0), hash_uniform(seed, "id", "first_id"), "id"))
    return others.withColumn("_k", k).where("_k = 1").select(*keys, "first_id", F.col("id").alias("second_id"))


def inspirations(parents: DataFrame, archive: DataFrame, n: int, elite_share: float = 0.3, seed: int = 0) -> DataFrame:
    """(parent, id, tier, place) of n archived correct rows for each parent: its problem's best (tier
    0), the best of its island (1), others of its island in hashed order (2), others of the problem
    (3). parents: (problem_id, island_idx, id); archive the same with combined_score and compile_ok.

    Each tier keeps n + 1 rows of a problem and island before parents meet them, so that the join
    is with a bounded list, not with the whole archive."""
    elites = int(n * elite_share)
    ok = archive.where("compile_ok = 1").select("problem_id", "island_idx", "id", "combined_score")
    u = hash_uniform(seed, "id")
    island, whole = Window.partitionBy("problem_id", "island_idx"), Window.partitionBy("problem_id")
    score = [F.desc_nulls_last("combined_score"), F.col("id")]
    ranked = ok.withColumns({"_best": F.row_number().over(whole.orderBy(*score)), "_elite": F.row_number().over(island.orderBy(*score)), "_mixed": F.row_number().over(island.orderBy(u, "id")), "_any": F.row_number().over(whole.orderBy(u, "id"))})
    # at most 2n + 2 rows can be chosen for a parent before these, so that many of each order suffice
    pool = ranked.where((F.col("_best") <= 1) | (F.col("_elite") <= elites + 2) | (F.col("_mixed") <= 2 * n + 2) | (F.col("_any") <= 2 * n + 2))
    p = parents.select("problem_id", F.col("island_idx").alias("_home"), F.col("id").alias("parent"))
    rows = p.join(pool, "problem_id").where("id <> parent")
    home = F.col("island_idx") == F.col("_home")
    tier = F.when(F.col("_best") == 1, 0).when(home & (F.col("_elite") <= elites + 2) & F.lit(elites > 0), 1).when(home, 2).otherwise(3)
    rows = rows.withColumn("tier", tier)
    within = F.row_number().over(Window.partitionBy("problem_id", "parent", "tier").orderBy(F.when(F.col("tier") <= 1, F.col("_elite")).otherwise(F.lit(0)), u, "id"))
    rows = rows.withColumn("_w", within).withColumn("tier", F.when((F.col("tier") == 1) & (F.col("_w") > elites), 2).otherwise(F.col("tier")))
    place = F.row_number().over(Window.partitionBy("problem_id", "parent").orderBy("tier", F.when(F.col("tier") <= 1, F.col("_w")).otherwise(F.lit(0)), u, "id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("problem_id", "parent", "id", "tier", "place")


def top_inspirations(parents: DataFrame, archive: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The k best archived correct rows for each parent, by score (else mean metric), that are neither
    the parent nor excluded. excluded: (parent, id), m at most for a parent, as inspirations gives."""
    value = F.coalesce("combined_score", mean_metric(F.col("public_metrics")), F.lit(float("-inf")))
    ranked = archive.where("compile_ok = 1").select("problem_id", "id", value.alias("_v"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v"), "id"))
    most = excluded.groupBy("parent").agg(F.count("*").alias("_m"))
    p = parents.select("problem_id", F.col("id").alias("parent")).join(most, "parent", "left").fillna(0, ["_m"])
    rows = p.join(ranked.withColumn("_r", rank("problem_id")), "problem_id").where((F.col("_r") <= k + 1 + F.col("_m")) & (F.col("id") != F.col("parent")))
    rows = rows.join(excluded.select("parent", "id"), ["parent", "id"], "left_anti")
    return rows.withColumn("place", rank("problem_id", "parent")).where(F.col("place") <= k).select("problem_id", "parent", "id", "place")


def without_seeds(programs: DataFrame, name: str = "patch_name") -> DataFrame:
    """Rows that are not a run's initial programs, with each problem's best after their removal."""
    rows = programs.where(~F.coalesce(F.startswith(F.col(name), F.lit("initial_program")), F.lit(False)))
    return rows.withColumn("is_best", (F.row_number().over(Window.partitionBy("problem_id").orderBy(*better_first())) == 1).cast("int"))


def next_beam_parent(programs: DataFrame, current: DataFrame, beams: int) -> DataFrame:
    """(problem_id, parent): the current one until it has `beams` children, then the problem's best.
    current: (problem_id, id)."""
    children = programs.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("_n"))
    now = current.join(children, "id", "left").select("problem_id", F.col("id").alias("_now"), F.coalesce("_n", F.lit(0)).alias("_n"))
    best = best_overall(programs.where("compile_ok = 1"), ["problem_id"]).select("problem_id", F.col("id").alias("_best"))
    keep = (F.col("_n") < beams) & F.col("_now").isNotNull()
    return best.join(now, "problem_id", "left").select("problem_id", F.when(keep, F.col("_now")).otherwise(F.col("_best")).alias("parent"))


STATE = "bandit long, arm string, pulls double, total double"


def bandit_step(state: dict[str, list[float]], arm: str, gain: float, decay: float) -> None:
    """One reward: pulls and totals of all arms shrink after it."""
    own = state.setdefault(arm, [0.0, 0.0])
    own[0] += 1.0
    own[1] += gain
    for s in state.values():
        s[0], s[1] = s[0] * decay, s[1] * decay


def gain(reward: Column, baseline: Column) -> Column:
    """Reward above the baseline, not below 0; a missing reward counts as none."""
    return F.greatest(F.coalesce(reward - F.coalesce(baseline, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def bandit_fold(log: DataFrame, decay: float = 0.95) -> DataFrame:
    """(bandit, arm, pulls, total) after a whole log (bandit, seq, arm, gain): every reward of a bandit
    makes the earlier ones count `decay` times as much. In closed form, a weight decay^(number of
    later rewards + 1) for each reward, so no bandit is folded in one task."""
    later = F.count("*").over(Window.partitionBy("bandit").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = log.withColumn("_w", F.pow(F.lit(decay), later.cast("double")))
    return rows.groupBy("bandit", "arm").agg(F.sum("_w").alias("pulls"), F.sum(F.col("_w") * F.col("gain")).alias("total"))


def bandit_stream(log: DataFrame, decay: float = 0.95) -> DataFrame:
    """The same over a stream, one small state (arms) for each bandit; a batch's rows in seq order."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        arms = {a: [p, t] for a, p, t in zip(*state.get)} if state.exists else {}
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            bandit_step(arms, r.arm, float(np.nan_to_num(r.gain)), decay)
        state.update((list(arms), [v[0] for v in arms.values()], [v[1] for v in arms.values()]))
        yield pd.DataFrame([(key[0], a, *v) for a, v in arms.items()], columns=["bandit", "arm", "pulls", "total"])

    return log.groupBy("bandit").applyInPandasWithState(fold, STATE, "arms array<string>, pulls array<double>, totals array<double>", "update", "NoTimeout")

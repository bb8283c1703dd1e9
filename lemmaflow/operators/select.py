"""Ranking, top-K selection, budgets and running windows over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def best_program(programs: DataFrame) -> DataFrame:
    """Best program of each problem: score descending, then time, then id; null scores left out."""
    return best_per(programs.where("combined_score is not null"), ["problem_id"], [F.desc("combined_score"), F.col("ts"), F.col("id")])


def top_unique(rows: DataFrame, k: int, mode: str = "prefer") -> DataFrame:
    """Top k statements of each problem, one for each signature, with their rank.

    Within a signature: semantic, score, shorter signature, shorter code, earlier, first. Among
    signatures the same without time, ties to the signature seen first. mode: prefer semantic ones,
    require them, or none (only compiling ones are looked at in any mode).
    """
    pool = rows.where((F.col("compile_ok") == 1) & (F.col("signature") != ""))
    if mode == "require":
        pool = pool.where("semantic_ok = 1")
    score = F.coalesce("combined_score", F.lit(0.0))
    seen = F.min("id").over(Window.partitionBy("problem_id", "signature"))
    first = [F.desc("semantic_ok")] if mode != "none" else []
    keys = [*first, score.desc(), F.length("signature"), F.length("code")]
    own = best_per(pool.withColumn("_seen", seen), ["problem_id", "signature"], [*keys, F.col("id")])
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(*keys, "_seen"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).drop("_seen")


def semantic_pool(rows: DataFrame, k: int) -> DataFrame:
    """Top k of each problem among semantic candidates if there are any, else among compiling ones."""
    w = Window.partitionBy("problem_id")
    pool = rows.where("compile_ok = 1").withColumn("_best", F.max("semantic_ok").over(w)).where(F.col("semantic_ok") == F.col("_best")).drop("_best")
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last("combined_score"), "ts", "id"))
    return pool.withColumn("rank", rank).where(F.col("rank") <= k)


def round_robin(rows: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """Splits a budget of attempts over each problem's statements in order: all get the same number,
    the first ones one more; those with none are left out; slots are numbered from 0."""
    w = Window.partitionBy("problem_id")
    i = F.row_number().over(w.orderBy(*order)) - 1
    rows = rows.withColumn("slot", i).withColumn("_m", F.count("*").over(w))
    n = F.expr(f"{budget} div _m") + (F.col("slot") < F.lit(budget) % F.col("_m")).cast("int")
    return rows.withColumn("n", n).where("n > 0").drop("_m")


def budget_sweep(ranked: DataFrame, ks: list[int], budget: int) -> DataFrame:
    """For each K that divides the budget: the top K statements with budget / K attempts each."""
    bad = [k for k in ks if k <= 0 or budget % k]
    if bad:
        raise ValueError(f"the budget {budget} is not a multiple of {bad}")
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(budget // k).alias("n")) for k in ks]))
    return ranked.withColumn("_c", choice).where(F.col("rank") <= F.col("_c.k")).select(*ranked.columns, F.col("_c.k").alias("k"), F.col("_c.n").alias("n"))


def attempt_slots(rows: DataFrame, n: str = "n") -> DataFrame:
    """One row for each attempt g = 0 .. n - 1."""
    return rows.where(F.col(n) > 0).withColumn("g", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))


def before_first_success(rows: DataFrame, keys: list[str], order: list[str], ok: str) -> DataFrame:
    """Attempts up to and with each key's first success; later ones are not needed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.max(ok).over(w), F.lit(0))).where("_done = 0").drop("_done")


def best_so_far(rows: DataFrame, keys: list[str], order: list[str], score: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("best_so_far", F.max(score).over(w))


def cumulative_cost(rows: DataFrame, keys: list[str], order: list[str], cost: str) -> DataFrame:
    """Running sum; at a row without a cost it is the next row's (leading and inner nulls filled from
    behind)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = F.when(F.col(cost).isNotNull(), F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_run", running)
    return rows.withColumn("cumulative_cost", F.first("_run", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).drop("_run")


def stagnation(rows: DataFrame, keys: list[str], order: list[str], fitness: list[str], limit: int) -> DataFrame:
    """Rows since fitness (compared field by field) last rose, and whether that is limit or more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    best = F.max(F.struct(*fitness)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_up", F.when(best.isNull() | (F.struct(*fitness) > best), 1).otherwise(0))
    rows = rows.withColumn("_part", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    streak = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return rows.withColumn("streak", streak).withColumn("stagnated", (F.col("streak") >= limit).cast("int")).drop("_up", "_part")


def stop_point(rows: DataFrame, keys: list[str], order: str, cost: str, cap: float) -> DataFrame:
    """First row of each key at which the running total reaches the cap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_t", F.sum(cost).over(w)).where(F.col("_t") >= cap).groupBy(*keys).agg(F.min(order).alias("stop_at"), F.min("_t").alias("total"))


def softmax(rows: DataFrame, keys: list[str], score: str, temperature: float = 3.5, floor: float = -1e9) -> DataFrame:
    """Probability of each row within its keys, missing and minus-infinite scores clamped."""
    x = F.greatest(F.coalesce(F.nanvl(score, F.lit(floor)), F.lit(floor)), F.lit(floor))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_e", F.exp((x - F.max(x).over(w)) / temperature))
    return rows.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def likelihood_ranks(rows: DataFrame, keys: list[str], log_prob: str, tokens: str | None = None, temperature: float = 3.5, tie: str = "id") -> DataFrame:
    """rows with score (the log-probability, a token if tokens are named), rank (greater scores first, missing ones and minus
    infinity last, ties by tie) and probability, the softmax within keys, where those are clamped."""
    each = F.when(F.col(tokens) > 0, F.col(log_prob) / F.col(tokens)) if tokens else F.col(log_prob)
    scored = rows.withColumn("score", each)
    usable = F.when(~F.isnan("score") & (F.col("score") > float("-inf")), F.col("score"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(usable), tie))
    return softmax(scored.withColumn("rank", place), keys, "score", temperature)


def admitted(rows: DataFrame, problems: DataFrame | None = None, first: int | None = None, header: str | None = None, forbidden: str = "sorry", key: str = "problem_id", index: str = "index") -> DataFrame:
    """rows with skipped, the reason for which a row is left out, null for those that stay: "not_listed" if problems (key) are given and
    its problem is none of them, "beyond_first" if its index is first or more, "header" if the named header column holds
    the forbidden word; the first reason that holds."""
    listed = problems.select(key).distinct().withColumn("_listed", F.lit(True)) if problems is not None else None
    out = rows.join(listed, key, "left") if problems is not None else rows.withColumn("_listed", F.lit(True))
    reason = F.when(F.col("_listed").isNull(), "not_listed")
    if first is not None:
        reason = reason.when(F.coalesce(F.col(index) >= first, F.lit(True)), "beyond_first")
    if header:
        reason = reason.when(F.contains(F.coalesce(header, F.lit("")), F.lit(forbidden)), "header")
    return out.withColumn("skipped", reason).drop("_listed")


def skipped_counts(rows: DataFrame) -> DataFrame:
    """(reason, rows) of admitted rows, "kept" for those that stay."""
    return rows.groupBy(F.coalesce("skipped", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


def first_occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return best_per(rows, keys, [F.col(order)])


def power_law(rows: DataFrame, keys: list[str], score: str, tie: str, alpha: float = 1.0) -> DataFrame:
    """Selection probability rank^-alpha, normalised within keys; best score first."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_w", F.pow(F.row_number().over(w.orderBy(F.desc(score), tie)).cast("double"), F.lit(-alpha)))
    return rows.withColumn("probability", F.col("_w") / F.sum("_w").over(w)).drop("_w")


def weighted(rows: DataFrame, keys: list[str], score: str, children: str, sharpness: float = 10.0, usage: float = 1.0) -> DataFrame:
    """Sigmoid of the score scaled by median and median absolute deviation, times a usage penalty,
    normalised within keys; uniform where all weights vanish."""
    grouped = rows.groupBy(*keys).agg(F.percentile(score, F.lit(0.5)).alias("_m"))
    away = rows.join(grouped, keys).withColumn("_d", F.abs(F.col(score) - F.col("_m")))
    mads = away.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("_s"))
    z = sharpness * (F.col(score) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-6))
    sigmoid = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    out = away.join(mads, keys).withColumn("_w", sigmoid / (1 + (1 + usage) * F.col(children)))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    count = F.count("*").over(Window.partitionBy(*keys))
    return out.withColumn("probability", F.when(total > 0, F.col("_w") / total).otherwise(1 / count)).drop("_m", "_d", "_s", "_w")


def bandit(rows: DataFrame, arm: str, reward: str, exploration: float = 1.0, epsilon: float = 0.2) -> DataFrame:
    """Arm probabilities: unseen arms first, else upper confidence bounds mean + c sqrt(2 ln t / n);
    the winners share 1 - epsilon, all arms epsilon."""
    totals = rows.groupBy(arm).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"))
    every = Window.partitionBy()  # one row an arm
    t = F.sum("n").over(every)
    bound = F.when(F.col("n") > 0, F.col("mean") + exploration * F.sqrt(2 * F.log(F.greatest(t, F.lit(1))) / F.col("n"))).otherwise(F.lit(float("inf")))
    totals = totals.withColumn("bound", bound)
    win = (F.col("bound") == F.max("bound").over(every)).cast("int")
    totals = totals.withColumn("_win", win)
    return totals.withColumn("probability", (1 - epsilon) * F.col("_win") / F.sum("_win").over(every) + epsilon / F.count("*").over(every)).drop("_win")


def pareto_front(rows: DataFrame, keys: list[str], x: str, y: str, more_x: bool = True, more_y: bool = True) -> DataFrame:
    """Rows that no other row of their key beats in x and y (more_x, more_y: greater is better); equal rows all
    stay, rows with a null or not-a-number in x or y are left out. One sorted pass: a row is beaten if a better x has at
    least as good a y, or an equal x a better one."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    best = F.max if more_y else F.min
    usable = rows.where(number(x) & number(y))
    order = Window.partitionBy(*keys).orderBy(F.desc(x) if more_x else F.asc(x)).rowsBetween(Window.unboundedPreceding, -1)
    tops = usable.groupBy(*keys, x).agg(best(y).alias("_top")).withColumn("_ahead", best("_top").over(order))
    better = F.col("_top") > F.col("_ahead") if more_y else F.col("_top") < F.col("_ahead")
    front = tops.where(F.col("_ahead").isNull() | better)
    return usable.join(front.select(*keys, x, F.col("_top").alias(y)), [*keys, x, y], "left_semi")


def migration_plan(programs: DataFrame, rate: float = 0.1, generation: str | None = None) -> DataFrame:
    """Movers of each island: max(1, size * rate) of its correct rows past the start (of a generation after 0, if its column is
    named, else with a parent), the best one kept, in hashed order; each goes to one of the other islands, chosen by a hash. None where there is
    no other island."""
    islands = F.broadcast(programs.where("island_idx is not null").agg(F.array_sort(F.collect_set("island_idx")).alias("_all")))  # one row: the islands' numbers
    w = Window.partitionBy("problem_id", "island_idx")
    rows = programs.withColumn("_size", F.count("*").over(w)).where(F.col("compile_ok") == 1).where(F.col(generation) > 0 if generation else F.col("parent_id").isNotNull())
    rows = rows.withColumn("_elite", F.row_number().over(w.orderBy(F.desc_nulls_last("combined_score"), "id"))).where("_elite > 1")
    turn = F.row_number().over(w.orderBy(F.md5(F.col("id").cast("string")), "id"))
    movers = rows.withColumn("_turn", turn).where(F.col("_turn") <= F.greatest(F.lit(1), F.floor(F.col("_size") * rate))).crossJoin(islands)
    others = F.array_remove("_all", F.col("island_idx"))
    to = F.get(others, F.pmod(F.xxhash64("id", F.lit(7)), F.size(others)).cast("int"))
    return movers.where(F.size(others) > 0).select("id", "problem_id", "island_idx", to.alias("to_island"))


def best_case(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's best case: score, then semantic, then compiling, then the shorter signature, then the
    shorter code, then the first id; missing scores come last."""
    order = [F.desc_nulls_last("combined_score"), F.desc("semantic_ok"), F.desc("compile_ok"), F.length("signature"), F.length("code"), F.col("id")]
    return best_per(rows, keys, order)


def top_programs(rows: DataFrame, n: int, by: str = "combined_score", correct_only: bool = False) -> DataFrame:
    """The n rows with the greatest value of `by`, ties to the smaller id; each task keeps n rows."""
    pool = rows.where("compile_ok = 1") if correct_only else rows
    return pool.where(F.col(by).isNotNull()).orderBy(F.desc(by), "id").limit(n)


def with_archive_flag(programs: DataFrame, archive: DataFrame) -> DataFrame:
    """programs with in_archive: is its id in the archive (id, repeats allowed)?"""
    kept = archive.select("id").distinct().withColumn("in_archive", F.lit(1))
    return programs.join(kept, "id", "left").fillna(0, ["in_archive"])


def with_answers(rows: DataFrame, answers: DataFrame, name: Column) -> DataFrame:
    """rows with the ground-truth answers of the theorem that `name` derives, null where there are none.
    answers: (theorem, answers), one row a theorem."""
    return rows.withColumn("theorem", name).join(answers, "theorem", "left")

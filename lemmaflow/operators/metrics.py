"""Predicates, scores and aggregates over candidate runs.

Functions take and return DataFrames or Columns; they run no action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions.text import exact_text
from lemmaflow.operators.quantiles import exact_quantiles


def ok_flag(metrics: Column, key: str) -> Column:
    """Is the metric 1? Numbers are cut to whole ones, true counts as 1, anything else as no. Null or
    broken JSON gives no."""
    text = F.get_json_object(metrics, f"$.{key}")
    return F.when(text == "true", True).otherwise(F.coalesce(text.try_cast("double").cast("int"), F.lit(0)) == 1)


def effective_calls(calls: Column, budget: Column, no_llm: Column, strict: bool = True) -> Column:
    """Calls of a run: recorded ones, or the budget where these are missing or not positive. Strict
    accounting counts runs without a model as 0; the looser one keeps a recorded 0."""
    if strict:
        return F.when(no_llm == 1, 0).when(calls > 0, calls).otherwise(budget)
    return F.coalesce(calls, budget)


def gated_score(compile_ok: Column, cycle: Column, semantic_ok: Column, beq_ok: Column, base: float = 100, w_cycle: float = 50, w_semantic: float = 100, w_beq: float = 200) -> Column:
    """Nothing without compiling; else a base, the weighted cycle score and the bonuses."""
    flag = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return flag(compile_ok) * (base + w_cycle * F.coalesce(cycle, F.lit(0.0)) + w_semantic * flag(semantic_ok) + w_beq * flag(beq_ok))


def reward(compile_ok: Column, semantic: Column, beq: Column, lam: float = 0.5) -> Column:
    return F.when(compile_ok == 1, semantic + lam * beq).otherwise(0.0)


def soft_success(compile_ok: Column, semantic: Column) -> Column:
    """Compiles and means the same; unknown counts as no."""
    return F.coalesce((compile_ok == 1) & (semantic == 1), F.lit(False))


def strict_success(compile_ok: Column, beq: Column) -> Column:
    """Compiles and is provably equivalent; unknown counts as no."""
    return F.coalesce((compile_ok == 1) & (beq == 1), F.lit(False))


def exact_duplicates(programs: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """(keys, id, copies): for every text that candidates of the same keys share, by exact_key, its first candidate's id and how many
    have it. Candidates without a declaration are no copies of each other and are left out."""
    own = exact_text(F.col(code))
    rows = programs.select(*keys, "id", F.sha2(own, 256).alias("_h"))  # the empty text's hash marks those without a declaration
    return rows.groupBy(*keys, "_h").agg(F.min("id").alias("id"), F.count("*").alias("copies")).where(F.col("_h") != F.sha2(F.lit(""), 256)).drop("_h")


def cycle_score(log_prob: Column, tokens: Column, temperature: float = 3.5, fallback: float = -100.0) -> Column:
    """exp of the log-probability per token over the temperature; no tokens or no number: fallback."""
    per = F.when(tokens > 0, log_prob / tokens)
    usable = F.when(per.isNull() | F.isnan(per) | (F.abs(per) == float("inf")), F.lit(fallback)).otherwise(per)
    return F.exp(usable / max(temperature, 1e-6))


def finite(x: Column) -> Column:
    """Null instead of what is not a number or is infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_array(x: Column) -> Column:
    return F.transform(x, finite)


def verdict(messages: Column) -> Column:
    """(passed, complete, errors, warnings, infos) of compiler messages (severity, data): passed
    without errors; complete if no warning tells of a sorry, either."""
    of = lambda kind: F.filter(messages, lambda m: F.lower(m["severity"]) == kind)
    passed = F.size(of("error")) == 0
    sorry = F.exists(of("warning"), lambda m: F.contains(m["data"], F.lit("declaration uses 'sorry'")))
    return F.struct(passed.alias("passed"), (passed & ~sorry).alias("complete"), *[F.size(of(k)).alias(f"{k}s") for k in ("error", "warning", "info")])


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(0.0)


def problem_metrics(programs: DataFrame, calls: DataFrame) -> DataFrame:
    """Per method and problem: calls, compiling and semantic candidates, hits (0/1) and densities."""
    counts = programs.groupBy("method", "problem_id").agg(F.count("*").alias("programs"), F.sum("compile_ok").alias("compile_count"), F.sum("semantic_ok").alias("semantic_count"))
    rows = counts.join(calls, "problem_id", "left").fillna(0, ["calls"])
    for kind in ("compile", "semantic"):
        rows = rows.withColumn(f"{kind}_hit", (F.col(f"{kind}_count") > 0).cast("long")).withColumn(f"{kind}_density", ratio(F.col(f"{kind}_count"), F.col("calls")))
    return rows


def run_totals(problems: DataFrame) -> DataFrame:
    """Per method: problems, calls, hits, hit rates, total densities, semantic per compiling."""
    sums = ["calls", "compile_count", "semantic_count", "compile_hit", "semantic_hit"]
    rows = problems.groupBy("method").agg(F.count("*").alias("problems"), *[F.sum(c).cast("long").alias(c) for c in sums])
    for kind in ("compile", "semantic"):
        rows = rows.withColumn(f"{kind}_hit_rate", F.col(f"{kind}_hit") / F.col("problems")).withColumn(f"{kind}_density", ratio(F.col(f"{kind}_count"), F.col("calls")))
    return rows.withColumn("semantic_per_compile", ratio(F.col("semantic_count"), F.col("compile_count")))


def signature_diversity(rows: DataFrame, keys: list[str], signature: str = "signature", order: str = "id") -> DataFrame:
    """Per key: signatures that are not empty, distinct ones, the most frequent one's count and its first
    row (first seen wins ties). Texts are hashed (128 bits) where they are read, so none is shuffled."""
    text = F.col(signature)
    hashed = rows.select(*keys, order, F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"), (F.length(text) > 0).alias("_some"))
    # _some is no filter: it would have the signature computed a second time, below the hashes
    counts = hashed.groupBy(*keys, "_h", "_g").agg(F.count("*").alias("n"), F.min(order).alias("seen"), F.max("_some").alias("_some")).where("_some")
    top = F.max_by("seen", F.struct(F.col("n"), -F.col("seen")))
    return counts.groupBy(*keys).agg(F.sum("n").alias("signatures"), F.count("*").alias("distinct_signatures"), F.max("n").alias("top_count"), top.alias("top_first"))


def _by_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, _c: how often each value occurs; then only distinct values meet in a window."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))


def gini(rows: DataFrame, keys: list[str], value: str, eps: float = 1e-12) -> DataFrame:
    """Gini coefficient of value within keys: sum((2i - n - 1) v) / (n sum v), values ascending. Equal
    values are counted first; those with ranks a + 1 .. a + c have the rank sum c a + c (c + 1) / 2."""
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v, c = F.col(value).cast("double"), F.col("_c")
    agg = _by_value(rows, keys, value).withColumn("_a", before).groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(c * v).alias("_s"), F.sum((c * F.col("_a") + c * (c + 1) / 2) * v).alias("_is"))
    return agg.select(*keys, ((2 * F.col("_is") - (F.col("_n") + 1) * F.col("_s")) / (F.col("_n") * F.col("_s") + eps)).alias("gini"))


def top_share(rows: DataFrame, keys: list[str], value: str, fraction: float = 0.1) -> DataFrame:
    """Share of the total that the largest ceil(fraction * n) values have, at least one value. Equal
    values are counted first."""
    counted = _by_value(rows, keys, value)
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.greatest(F.lit(1), F.ceil(F.sum("_c").over(w) * fraction))
    took = F.greatest(F.lit(0), F.least(F.col("_c"), k - before))
    return counted.withColumn("_t", took).groupBy(*keys).agg(ratio(F.sum(F.col("_t") * F.col(value)), F.sum(F.col("_c") * F.col(value))).alias("top_share"))


def numeric_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: count, min, max, mean and exact median, nulls skipped."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "field", "x")
    out = long.groupBy("field").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    return out.join(exact_quantiles(long, ["field"], "x", {"median": 0.5}), "field", "left")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the value at round-half-even(p * (n - 1)), from 0. Equal values are
    counted first."""
    w = Window.partitionBy(*keys)
    ranked = _by_value(rows, keys, value).withColumn("_z", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.bround(p * (F.col("_n") - 1))
    return ranked.groupBy(*keys).agg(*[F.max(F.when((at(p) < F.col("_z")) & (at(p) >= F.col("_z") - F.col("_c")), F.col(value))).alias(name) for name, p in points.items()])


def proof_hits(attempts: DataFrame, expected: DataFrame, methods: list[int]) -> DataFrame:
    """Per expected group and method: attempts, passes, any pass, any complete; groups without
    attempts count as failures."""
    seen = attempts.groupBy("group_id", "method").agg(F.count("*").alias("attempts"), F.sum("pass_ok").alias("passes"), F.max("pass_ok").alias("pass_hit"), F.max("complete_ok").alias("complete_hit"))
    # one row a method: a small grid, not a join of large tables
    grid = expected.select("group_id", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return grid.join(seen, ["group_id", "method"], "left").fillna(0, ["attempts", "passes", "pass_hit", "complete_hit"])


def solved_rollup(hits: DataFrame) -> DataFrame:
    """Solved counts and ratios by method and over all (all_methods = 1)."""
    rows = hits.rollup("method").agg(F.grouping("method").cast("int").alias("all_methods"), F.count("*").alias("problems"), F.sum("pass_hit").alias("passed"), F.sum("complete_hit").alias("completed"), F.max("attempts").alias("max_attempts"))
    return rows.withColumns({"pass_rate": ratio(F.col("passed"), F.col("problems")), "complete_rate": ratio(F.col("completed"), F.col("problems"))})


def failure_class(message: Column) -> Column:
    """Compile-error class by the first rule that fits."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: _any([F.contains(low, F.lit(p)) for p in parts])
    return (
        F.when(low == "", "unknown")
        .when(has("type mismatch"), "type_mismatch")
        .when(has("unknown identifier", "unknown constant"), "unknown_identifier")
        .when(has("unbound", "not in scope"), "unbound_variable")
        .when(has("expected") & has("got"), "syntax_error")
        .when(has("failed to synthesize"), "typeclass_error")
        .when(has("ambiguous"), "ambiguous_identifier")
        .when(has("invalid"), "invalid_syntax")
        .when(has("timeout"), "timeout")
        .when(has("import"), "import_error")
        .otherwise("other")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def missing_ranges(present: DataFrame, keys: list[str], index: str, until: str, expected: DataFrame | None = None) -> DataFrame:
    """Ranges (first, last) of whole numbers 0 .. until - 1 that are missing, for each key: gaps
    between neighbours, found without listing the numbers. expected (keys, until) names the keys of
    which no number may be present, too: then all are missing."""
    w = Window.partitionBy(*keys).orderBy(index)
    rows = present.select(*keys, index, until).distinct()
    before = F.coalesce(F.lag(index).over(w), F.lit(-1))
    after = F.coalesce(F.lead(index).over(w), F.col(until))
    gaps = rows.withColumn("_a", before).withColumn("_z", after).withColumn("_first", F.lag(index).over(w).isNull())
    head = gaps.where(F.col("_first") & (F.col(index) > 0)).select(*keys, F.lit(0).alias("first"), (F.col(index) - 1).alias("last"))
    rest = gaps.where(F.col("_z") > F.col(index) + 1).select(*keys, (F.col(index) + 1).alias("first"), (F.col("_z") - 1).alias("last"))
    found = head.unionByName(rest)
    if expected is None:
        return found
    absent = expected.where(F.col(until) > 0).join(present.select(*keys), keys, "left_anti")
    return found.unionByName(absent.select(*keys, F.lit(0).alias("first"), (F.col(until) - 1).alias("last")))


def compress_ranges(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Ranges (first, last) of consecutive whole numbers, repeats counting once."""
    w = Window.partitionBy(*keys).orderBy(index)
    marked = rows.select(*keys, index).distinct().withColumn("_island", F.col(index) - F.row_number().over(w))
    return marked.groupBy(*keys, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_island")


def termination_class(reason: Column) -> Column:
    """Why a run ended, from its reason text."""
    has = lambda part: F.contains(reason, F.lit(part))
    return F.when(reason.isNull(), "normal_completion").when(has("max_llm_calls") | has("max_evals") | has("max_time"), "budget_exhausted").when(has("stagnation"), "exploration_stagnation").otherwise("unknown")


def infra_retries(error: Column, count: Column, patterns: list[str]) -> Column:
    """(retryable, retries): does the error fit a pattern, and how many retries a record has used; a
    retryable one without a count has used one."""
    hit = F.coalesce(_any([error.rlike(p) for p in patterns]) & (F.trim(error) != ""), F.lit(False))
    return F.struct(hit.alias("retryable"), F.when(count > 0, count).otherwise(hit.cast("int")).cast("int").alias("retries"))


def call_accounting(raw: Column, debited: Column, repair: Column, semantic_repair: Column) -> Column:
    """(total, patch): budget calls are raw plus debited ones; patch calls are raw ones without repairs,
    never below zero."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.struct((zero(raw) + zero(debited)).alias("total"), F.greatest(zero(raw) - zero(repair) - zero(semantic_repair), F.lit(0)).cast("long").alias("patch"))


def strict_rows(programs: DataFrame) -> DataFrame:
    """Per problem: best score, hits by the plain flags, best program (score, then time, then id)."""
    best = F.min_by("id", F.when(F.col("combined_score").isNotNull(), F.struct((-F.col("combined_score")).alias("s"), "ts", "id")))
    return programs.groupBy("problem_id").agg(F.count("*").alias("programs"), F.max("combined_score").alias("best_score"), best.alias("best_id"), F.max("compile_ok").alias("compile_hit"), F.max("semantic_ok").alias("semantic_hit"))


def score_histogram(rows: DataFrame, score: str) -> DataFrame:
    """How many rows have each score, cut to a whole number."""
    return rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("long").alias("score")).agg(F.count("*").alias("n"))


def cost_summary(programs: DataFrame, kinds: list[str], keys: list[str]) -> DataFrame:
    """Per key: total of each cost in the metadata JSON, cost for each program, average, best and
    median score, share of correct rows."""
    cost = {k: F.coalesce(F.get_json_object("metadata", f"$.{k}").try_cast("double"), F.lit(0.0)) for k in kinds}
    sums = [F.sum(c).alias(k) for k, c in cost.items()]
    out = programs.groupBy(*keys).agg(F.count("*").alias("programs"), *sums, F.avg("combined_score").alias("mean_score"), F.max("combined_score").alias("best_score"), F.avg(F.col("correct").cast("double")).alias("correct_share"))
    out = out.join(exact_quantiles(programs, keys, "combined_score", {"median_score": 0.5}), keys, "left")
    return out.withColumn("cost_per_program", sum((F.col(k) for k in kinds), F.lit(0.0)) / F.col("programs"))


def failure_table(failures: DataFrame) -> DataFrame:
    """Per error type: failures, how many ended in each state, repair attempts."""
    state = lambda s: F.sum((F.col("final_status") == s).cast("long")).alias(s)
    return failures.groupBy("error_type").agg(F.count("*").alias("failures"), state("repair_success"), state("repair_exhausted"), state("no_repair"), F.sum("repair_attempts").alias("repair_attempts"))


def method_means(results: DataFrame, methods: list[str], fields: list[str]) -> DataFrame:
    """One row a method out of columns named method_field: means that skip nulls, 0 without values."""
    rows = results.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{f}").cast("double").alias(f) for f in fields]) for m in methods])).alias("r")).select("r.*")
    return rows.groupBy("method").agg(F.count("*").alias("problems"), *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"mean_{f}") for f in fields])


def repeated_runs(runs: DataFrame, key: str = "program_id") -> DataFrame:
    """Per program: valid and invalid runs, the first error, all distinct errors, mean and population
    deviation of the time. runs: (key, run, valid boolean, error, seconds)."""
    bad = ~F.col("valid") & (F.coalesce("error", F.lit("")) != "")
    return runs.groupBy(key).agg(
        F.sum(F.col("valid").cast("long")).alias("valid_runs"), F.sum((~F.col("valid")).cast("long")).alias("invalid_runs"),
        F.min_by("error", F.when(bad, F.col("run"))).alias("first_error"), F.sort_array(F.collect_set(F.when(bad, F.col("error")))).alias("errors"),
        F.avg("seconds").alias("mean_seconds"), F.stddev_pop("seconds").alias("deviation_seconds"),
    )


def method_summary(problems: DataFrame, diversity: DataFrame, n: int) -> DataFrame:
    """Per method over a declared number of problems n: hits, hit rate, successes, calls, density over
    all calls, mean of the problems' densities, distinct signatures in all and for each call, and the
    most copies of one signature; once for compiling and once for semantic candidates (kind).
    problems: problem_metrics; diversity: (method, problem_id, kind, distinct_signatures, top_count)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_count").alias("ok"), F.col(f"{k}_hit").alias("hit"), F.col(f"{k}_density").alias("density")) for k in ("compile", "semantic")]))
    rows = problems.select("method", "problem_id", "calls", kinds.alias("k")).select("method", "problem_id", "calls", "k.*")
    rows = rows.join(diversity, ["method", "problem_id", "kind"], "left").fillna(0, ["distinct_signatures", "top_count"])
    total = lambda c: F.sum(c).cast("long").alias(c)
    out = rows.groupBy("method", "kind").agg(total("hit"), total("ok"), total("calls"), F.sum("density").alias("_d"), F.sum("distinct_signatures").cast("long").alias("signatures"), F.max("top_count").alias("most_copies"))
    every = F.lit(n)
    return out.withColumns(
        {"hit_rate": ratio(F.col("hit"), every), "density": ratio(F.col("ok"), F.col("calls")), "density_mean": ratio(F.col("_d"), every), "signature_density": ratio(F.col("signatures"), F.col("calls"))}
    ).drop("_d")


def statement_metrics(programs: DataFrame, statement: Column) -> DataFrame:
    """Per method: problems, share of them with a compiling candidate and with a semantic statement, and
    how many distinct statements (hashed, 128 bits) are both, in all, at least and at most in a problem.
    programs: (method, problem_id, compile_ok, semantic_ok); an empty statement counts for nothing."""
    good = (F.col("compile_ok") == 1) & (F.col("semantic_ok") == 1) & (statement != "")
    named = programs.select("method", "problem_id", "compile_ok", F.when(good, F.struct(F.xxhash64(statement), F.xxhash64(F.lit(1), statement))).alias("_key"))
    each = named.groupBy("method", "problem_id", "_key").agg(F.max("compile_ok").alias("_ok"))  # one row a statement
    own = each.groupBy("method", "problem_id").agg(F.max("_ok").alias("_hit"), F.count("_key").alias("_n"))
    return own.groupBy("method").agg(
        F.count("*").alias("problems"), F.avg((F.col("_hit") == 1).cast("double")).alias("compile_hit_rate"), F.avg((F.col("_n") > 0).cast("double")).alias("semantic_hit_rate"),
        F.sum("_n").alias("semantic_statements"), F.min("_n").alias("least"), F.max("_n").alias("most"),
    )


def query_costs(log: DataFrame, prices: DataFrame, keys: list[str], model: str, units: str, price: str = "price") -> DataFrame:
    """keys, queries, cost (units times their model's price, 0 for a model without one) and unknown_models, how many queries had none.
    prices: one row a model."""
    rows = log.join(prices.select(model, F.col(price).alias("_price")), model, "left")
    return rows.groupBy(*keys).agg(F.count("*").alias("queries"), F.sum(F.coalesce("_price", F.lit(0.0)) * F.col(units)).alias("cost"), F.sum(F.col("_price").isNull().cast("long")).alias("unknown_models"))

"""Proof attempts: alignment with statements, roll-ups, and plans for what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions import text as T
from lemmaflow.operators.metrics import infra_retries, ratio
from lemmaflow.operators.rounds import written


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts numbered within their keys by k, then g, then name; missing numbers come last."""
    late = lambda c: F.coalesce(c, F.lit(1_000_000))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(late("k"), late("g"), "name")))


def aligned(attempts: DataFrame, statements: DataFrame) -> DataFrame:
    """attempts (base_id, code, ...) with stmt_ok: is there a statement of that id, with at least one
    chunk, whose chunks the code without comments keeps? statements: (base_id, statement), one a
    base_id. An equal join; the test is a filter on its rows."""
    chunks = statements.select("base_id", T.skeleton(F.col("statement")).alias("_chunks"))
    clean = T.without_comments(F.col("code"), "line_start")
    ok = (F.size("_chunks") > 0) & T.keeps_skeleton(clean, F.col("_chunks"))
    return attempts.join(chunks, "base_id", "left").withColumn("stmt_ok", F.coalesce(ok, F.lit(False)).cast("int")).drop("_chunks")


def aligned_with_any(attempts: DataFrame, statements: DataFrame) -> DataFrame:
    """(attempt_id, stmt_ok): does an attempt keep any of its problem's statements? A statement's chunks, in an attempt that
    keeps them, stand there with all words within them, so the rarest such word of a statement, counted over its problem's
    attempts, proposes attempts, and what is proposed is verified. A problem with very many attempts
    and statements is joined by its words, not as a whole; only statements of chunks of one or two words, which have no
    word within, meet all attempts of their problem. Each attempt's code is cleaned once."""
    clean = written(attempts.select("attempt_id", "group_id", T.without_comments(F.col("code"), "line_start").alias("_clean")))
    chunks = statements.select("group_id", T.skeleton(F.col("statement")).alias("_chunks")).where(F.size("_chunks") > 0).distinct()
    words = lambda text: F.split(text, r"\s+")
    within = F.array_distinct(F.flatten(F.transform("_chunks", lambda c: F.slice(words(c), 2, F.greatest(F.size(words(c)) - 2, F.lit(0))))))
    chunks = written(chunks.withColumns({"_s": F.xxhash64("group_id", "_chunks"), "_words": within}))

    sought = chunks.select("group_id", "_s", F.explode("_words").alias("w"))
    own = clean.select("attempt_id", "group_id", F.explode(F.array_distinct(words(F.col("_clean")))).alias("w"))
    places = written(own.join(sought.select("group_id", "w").distinct(), ["group_id", "w"]))
    often = places.groupBy("group_id", "w").agg(F.count("*").alias("n"))
    rarest = sought.join(often, ["group_id", "w"], "left").groupBy("group_id", "_s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r")).where("r.n > 0")
    proposed = rarest.select("group_id", "_s", F.col("r.w").alias("w")).join(places, ["group_id", "w"]).select("attempt_id", "group_id", "_s")
    short = chunks.where(F.size("_words") == 0).select("group_id", "_s").join(clean.select("attempt_id", "group_id"), "group_id").select("attempt_id", "group_id", "_s")
    pairs = proposed.union(short).join(chunks.select("group_id", "_s", "_chunks"), ["group_id", "_s"]).join(clean, ["attempt_id", "group_id"])
    hit = pairs.where(T.keeps_skeleton(F.col("_clean"), F.col("_chunks"))).select("attempt_id").distinct()
    return attempts.select("attempt_id").join(hit.withColumn("stmt_ok", F.lit(1)), "attempt_id", "left").fillna(0, ["stmt_ok"])


def nested_counts(problems: DataFrame) -> DataFrame:
    """Counts out of nested attempts: problems (group_id, attempts array of flags as booleans)."""
    of = lambda flag: F.size(F.filter("attempts", lambda a: F.coalesce(a[flag], F.lit(False)))).cast("long").alias(f"{flag}_attempts")
    return problems.where("attempts is not null").select("group_id", F.size("attempts").cast("long").alias("total_attempts"), of("pass"), of("complete"), of("theorem_complete"))


def group_sets(attempts: DataFrame) -> DataFrame:
    """Per problem and method: did any attempt pass, complete, or complete with the statement kept?"""
    return attempts.groupBy("group_id", "method").agg(F.count("*").alias("attempts"), F.max("pass_ok").alias("pass"), F.max("complete_ok").alias("complete"), F.max(F.col("complete_ok") * F.col("stmt_ok")).alias("aligned"))


def problem_sets(index: DataFrame) -> DataFrame:
    """All problems of an index and whether any has allocations. index: (group_id, allocations)."""
    return index.groupBy("group_id").agg(F.max((F.size("allocations") > 0).cast("int")).alias("active"))


def both_active(groups: DataFrame, a: int, b: int) -> DataFrame:
    """Problems that both methods attempted."""
    own = groups.where(F.col("method").isin(a, b) & (F.col("attempts") > 0)).groupBy("group_id").agg(F.count_distinct("method").alias("n"))
    return own.where("n = 2").select("group_id")


def utility_table(groups: DataFrame, problems: DataFrame, methods: list[int]) -> DataFrame:
    """Solved problems by method and field (pass, complete, aligned): over all problems, and over
    those with allocations, with ratios. groups: group_sets; problems: problem_sets."""
    grid = problems.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    rows = grid.join(groups, ["group_id", "method"], "left").fillna(0, ["pass", "complete", "aligned"]).unpivot(["method", "active"], ["pass", "complete", "aligned"], "field", "hit")
    out = rows.groupBy("method", "field").agg(F.count("*").alias("problems"), F.sum("hit").cast("long").alias("solved"), F.sum("active").cast("long").alias("problems_active"), F.sum(F.col("hit") * F.col("active")).cast("long").alias("solved_active"))
    return out.withColumns({"ratio": ratio(F.col("solved"), F.col("problems")), "ratio_active": ratio(F.col("solved_active"), F.col("problems_active"))})


def attempt_summary(attempts: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: problems, attempts, most attempts of a problem, and problems with any attempt that
    passes, completes, and the same with the statement kept; ratios by expected problems."""
    flags = {"passed": F.col("pass_ok"), "completed": F.col("complete_ok"), "strict_passed": F.col("pass_ok") * F.col("stmt_ok"), "strict_completed": F.col("complete_ok") * F.col("stmt_ok")}
    seen = attempts.groupBy("group_id").agg(F.count("*").alias("attempts"), *[F.max(c).alias(n) for n, c in flags.items()])
    rows = expected.select("group_id").join(seen, "group_id", "left").fillna(0)
    out = rows.agg(F.count("*").alias("problems"), F.sum("attempts").alias("attempts"), F.max("attempts").alias("max_attempts"), *[F.sum(n).cast("long").alias(n) for n in flags])
    return out.withColumns({f"{n}_ratio": ratio(F.col(n), F.col("problems")) for n in flags})


def selection_stats(per_problem: DataFrame, k: int) -> DataFrame:
    """One row over problems (selected, skipped): processed, without any, under k, skipped, written."""
    n = lambda c: F.sum(c.cast("long"))
    used = ~F.col("skipped")
    return per_problem.agg(n(used).alias("processed"), n(used & (F.col("selected") == 0)).alias("zero_selected"), n(used & (F.col("selected") < k)).alias("under_k"), n(F.col("skipped")).alias("skipped"), F.sum(F.when(used, F.col("selected")).otherwise(0)).alias("written"))


def success_summary(rows: DataFrame, ok: str) -> DataFrame:
    """Attempted, solved, rate."""
    return rows.agg(F.count("*").alias("attempted"), F.sum(F.col(ok).cast("long")).alias("solved")).withColumn("rate", ratio(F.col("solved"), F.col("attempted")))


def _done(output: Column, code: Column, error: Column) -> Column:
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return (text(error) == "") & ((text(output) != "") | ~text(code).isin("", "None"))


def resume_targets(wanted: DataFrame, records: DataFrame, patterns: list[str], most_retries: int = 0, max_tokens: int | None = None) -> DataFrame:
    """(origin, g) still to be run: slots 0 .. n - 1 without a record; with max_tokens, those made with
    another limit and no output; and, where patterns are given, those that failed for a retryable
    reason fewer than most_retries times (0: no limit). wanted: (origin, n); records: (origin, g,
    model_output, full_code, error, infra_retry, max_tokens), one for each slot."""
    slots = wanted.where("n > 0").select("origin", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("g"))
    rows = slots.join(records.withColumn("_seen", F.lit(True)), ["origin", "g"], "left")
    again = F.col("_seen").isNull()
    if max_tokens is not None:
        again = again | ((F.coalesce("max_tokens", F.lit(0)) != max_tokens) & ~_done(F.col("model_output"), F.col("full_code"), F.col("error")))
    if patterns:
        state = infra_retries(F.col("error"), F.col("infra_retry"), patterns)
        again = again | (state["retryable"] & (F.lit(most_retries <= 0) | (state["retries"] < most_retries)))
    return rows.where(again).select("origin", "g")


def recompile_plan(inputs: DataFrame, existing: DataFrame, solved_by: str | None = "complete_ok") -> DataFrame:
    """(group_id, name, reason) of attempts to compile: new, changed code, or a system error before;
    groups with a solved attempt are left out. inputs: (group_id, name, code); existing: (name,
    code, system_error, flags)."""
    before = existing.select("name", F.xxhash64("code").alias("_old"), F.coalesce("system_error", F.lit("")).alias("_error"), *([solved_by] if solved_by else []))
    rows = inputs.select("group_id", "name", F.xxhash64("code").alias("_new")).join(before, "name", "left")
    if solved_by:
        solved = rows.where(F.col(solved_by) == 1).select("group_id").distinct()
        rows = rows.join(solved, "group_id", "left_anti")
    reason = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("_new"), "changed").when(F.col("_error") != "", "system_error")
    return rows.withColumn("reason", reason).where("reason is not null").select("group_id", "name", "reason")


def missing_samples(tasks: DataFrame, present: DataFrame) -> DataFrame:
    """Per finished task with gaps: how many samples are missing and the ranges they form, by first
    sample. tasks: (task, n, finished); present: (task, sample)."""
    all_of = tasks.where("finished and n > 0").select("task", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("sample"))
    gaps = all_of.join(present.select("task", "sample").distinct(), ["task", "sample"], "left_anti")
    isle = F.col("sample") - F.row_number().over(Window.partitionBy("task").orderBy("sample"))
    ranges = gaps.withColumn("_i", isle).groupBy("task", "_i").agg(F.min("sample").alias("first"), F.max("sample").alias("last"), F.count("*").alias("_n"))
    return ranges.groupBy("task").agg(F.sum("_n").alias("missing"), F.count("*").alias("ranges"), F.min("first").alias("first_missing"), F.max("last").alias("last_missing"))


def diff_counts(diffs: DataFrame) -> DataFrame:
    """(diff_id, file, added, deleted, modified) of unified diffs (diff_id, diff): in each hunk as many
    lines count as modified as it both adds and removes."""
    files = diffs.select("diff_id", F.explode(F.split("diff", r"(?m)^(?=--- [^\n]*\n\+\+\+ )")).alias("part")).where(F.col("part").startswith("--- "))
    hunks = files.select("diff_id", F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1).alias("file"), F.posexplode(F.split("part", r"(?m)^@@[^\n]*(?:\n|\z)")).alias("_hunk", "body")).where("_hunk > 0")
    plus, minus = F.regexp_count("body", F.lit(r"(?m)^\+")), F.regexp_count("body", F.lit(r"(?m)^-"))
    each = hunks.select("diff_id", "file", plus.alias("p"), minus.alias("m"), F.least(plus, minus).alias("both"))
    total = lambda c: F.sum(c).cast("long")
    return each.groupBy("diff_id", "file").agg(total(F.col("p") - F.col("both")).alias("added"), total(F.col("m") - F.col("both")).alias("deleted"), total(F.col("both")).alias("modified"))

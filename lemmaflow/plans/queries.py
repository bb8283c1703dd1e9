"""The registered queries of the library over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import text as T
from lemmaflow.operators import compare, lineage, metrics, resampling, select, vectors
from lemmaflow.plans import views
from lemmaflow.plans.views import with_views
from lemmaflow.streaming import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable:
    """Registers a query under its function's name, with its SQL over the named views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *needs) if needs else sql
        return f

    return add


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _problems(spark: SparkSession, sf: str) -> DataFrame:
    t = views.terminations(spark, sf)
    calls = t.select("problem_id", metrics.effective_calls(F.col("calls"), F.lit(100), F.col("no_llm")).cast("long").alias("calls"))
    return metrics.problem_metrics(views.programs(spark, sf), calls)


_CALLS = "calls_of AS (SELECT problem_id, CAST(CASE WHEN no_llm = 1 THEN 0 WHEN calls > 0 THEN calls ELSE 100 END AS BIGINT) AS calls FROM terminations)"
_PROBLEMS = f"""{_CALLS}, counted AS (
    SELECT method, problem_id, count(*) AS programs, CAST(sum(compile_ok) AS BIGINT) AS compile_count, CAST(sum(semantic_ok) AS BIGINT) AS semantic_count
    FROM programs GROUP BY ALL
), problems AS (
    SELECT method, c.problem_id, programs, compile_count, semantic_count, coalesce(k.calls, 0) AS calls,
           CAST(compile_count > 0 AS BIGINT) AS compile_hit, CAST(semantic_count > 0 AS BIGINT) AS semantic_hit,
           CASE WHEN coalesce(k.calls, 0) > 0 THEN compile_count / k.calls ELSE 0.0 END AS compile_density,
           CASE WHEN coalesce(k.calls, 0) > 0 THEN semantic_count / k.calls ELSE 0.0 END AS semantic_density
    FROM counted c LEFT JOIN calls_of k ON k.problem_id = c.problem_id)"""


@query(f"WITH {_PROBLEMS} SELECT * REPLACE (round(compile_density, 6) AS compile_density, round(semantic_density, 6) AS semantic_density) FROM problems", "programs", "terminations")
def problem_metrics(spark, sf):
    return _rounded(_problems(spark, sf))


@query(
    f"""WITH {_PROBLEMS} SELECT method, count(*) AS problems, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(compile_count) AS BIGINT) AS compile_count,
    CAST(sum(semantic_count) AS BIGINT) AS semantic_count, CAST(sum(compile_hit) AS BIGINT) AS compile_hit, CAST(sum(semantic_hit) AS BIGINT) AS semantic_hit,
    round(sum(compile_hit) / count(*), 6) AS compile_hit_rate, round(sum(semantic_hit) / count(*), 6) AS semantic_hit_rate,
    round(coalesce(sum(compile_count) / nullif(sum(calls), 0), 0), 6) AS compile_density, round(coalesce(sum(semantic_count) / nullif(sum(calls), 0), 0), 6) AS semantic_density,
    round(coalesce(sum(semantic_count) / nullif(sum(compile_count), 0), 0), 6) AS semantic_per_compile FROM problems GROUP BY method""",
    "programs", "terminations",
)
def run_totals(spark, sf):
    return _rounded(metrics.run_totals(_problems(spark, sf)))


@query("SELECT problem_id, id, combined_score FROM programs WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, ts, id) = 1", "programs")
def best_program(spark, sf):
    return select.best_program(views.programs(spark, sf)).select("problem_id", "id", "combined_score")


@query(
    """SELECT id, CAST(compile_ok * (100 + 50 * 0.5 + 100 * semantic_ok) AS DOUBLE) AS score, CAST(CASE WHEN compile_ok = 1 THEN semantic_ok + 0.5 * semantic_ok ELSE 0 END AS DOUBLE) AS reward,
    coalesce(CAST(CAST(json_extract_string(public_metrics, '$.k') AS DOUBLE) AS INTEGER) = 1, false) AS k_is_one FROM programs""",
    "programs",
)
def candidate_scores(spark, sf):
    p = views.programs(spark, sf)
    score = metrics.gated_score(F.col("compile_ok"), F.lit(0.5), F.col("semantic_ok"), F.lit(0))
    return p.select("id", _r(score).alias("score"), _r(metrics.reward(F.col("compile_ok"), F.col("semantic_ok"), F.col("semantic_ok"))).alias("reward"), metrics.ok_flag(F.col("public_metrics"), "k").alias("k_is_one"))


_SIGNED = r"""signed AS (SELECT *, 'theorem _' || rtrim(split_part(' : ' || split_part(code, 'theorem t' || id || ' : ', 2), ':=', 1)) AS signature FROM candidates)"""


@query(
    f"""WITH {_SIGNED}, counted AS (SELECT problem_id, signature, count(*) AS n, min(id) AS seen FROM signed GROUP BY ALL)
    SELECT problem_id, CAST(sum(n) AS BIGINT) AS signatures, count(*) AS distinct_signatures, max(n) AS top_count, arg_max(seen, n * 10000000000 - seen) AS top_first FROM counted GROUP BY problem_id""",
    "candidates",
)
def signature_diversity(spark, sf):
    c = views.candidates(spark, sf)
    rows = c.select("id", "problem_id", T.signature(F.col("code")).alias("signature"))
    return metrics.signature_diversity(rows, ["problem_id"])


@query(
    f"""WITH {_PROBLEMS}, ranked AS (SELECT method, semantic_count AS v, row_number() OVER (PARTITION BY method ORDER BY semantic_count) AS i FROM problems)
    SELECT method, round((2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v) + 1e-12), 6) AS gini FROM ranked GROUP BY method""",
    "programs", "terminations",
)
def semantic_gini(spark, sf):
    return _rounded(metrics.gini(_problems(spark, sf), ["method"], "semantic_count"))


@query(
    f"""WITH {_PROBLEMS}, ranked AS (SELECT method, semantic_count AS v, row_number() OVER (PARTITION BY method ORDER BY semantic_count DESC) AS i, count(*) OVER (PARTITION BY method) AS n FROM problems)
    SELECT method, round(sum(v) FILTER (i <= greatest(1, ceil(n * 0.1))) / sum(v), 6) AS top_share FROM ranked GROUP BY method""",
    "programs", "terminations",
)
def semantic_top_share(spark, sf):
    return _rounded(metrics.top_share(_problems(spark, sf), ["method"], "semantic_count"))


@query(
    """SELECT * FROM (SELECT 'c_acctbal' AS field, count(c_acctbal) AS n, min(c_acctbal) AS "min", max(c_acctbal) AS "max", round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median FROM customer
    UNION ALL SELECT 'c_nationkey', count(c_nationkey), min(c_nationkey), max(c_nationkey), round(avg(c_nationkey), 6), round(median(c_nationkey), 6) FROM customer)"""
)
def numeric_summary(spark, sf):
    return _rounded(metrics.numeric_summary(views.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


@query(
    """WITH ranked AS (SELECT problem_id, combined_score AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY problem_id) AS n FROM programs WHERE combined_score IS NOT NULL WINDOW w AS (PARTITION BY problem_id ORDER BY combined_score))
    SELECT problem_id, max(v) FILTER (i = round_even(0.25 * (n - 1), 0)) AS p25, max(v) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (i = round_even(0.9 * (n - 1), 0)) AS p90 FROM ranked GROUP BY problem_id""",
    "programs",
)
def score_quantiles(spark, sf):
    return metrics.nearest_rank(views.programs(spark, sf), ["problem_id"], "combined_score", {"p25": 0.25, "p50": 0.5, "p90": 0.9})


_HITS = """seen AS (SELECT group_id, method, count(*) AS attempts, sum(pass_ok) AS passes, max(pass_ok) AS pass_hit, max(complete_ok) AS complete_hit FROM attempts GROUP BY ALL),
hits AS (SELECT e.group_id, m.method, coalesce(attempts, 0) AS attempts, CAST(coalesce(passes, 0) AS BIGINT) AS passes, coalesce(pass_hit, 0) AS pass_hit, coalesce(complete_hit, 0) AS complete_hit
    FROM expected e CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS method) m LEFT JOIN seen s ON s.group_id = e.group_id AND s.method = m.method)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.proof_hits(views.attempts(spark, sf), views.expected(spark, sf), [0, 1, 2, 3])


@query(f"WITH {_HITS} SELECT * FROM hits", "attempts", "expected")
def proof_hits(spark, sf):
    return _hits(spark, sf)


@query(
    f"""WITH {_HITS} SELECT method, CAST(grouping(method) AS INTEGER) AS all_methods, count(*) AS problems, CAST(sum(pass_hit) AS BIGINT) AS passed, CAST(sum(complete_hit) AS BIGINT) AS completed, max(attempts) AS max_attempts,
    round(sum(pass_hit) / count(*), 6) AS pass_rate, round(sum(complete_hit) / count(*), 6) AS complete_rate FROM hits GROUP BY ROLLUP (method)""",
    "attempts", "expected",
)
def solved_rollup(spark, sf):
    return _rounded(metrics.solved_rollup(_hits(spark, sf)))


_HEADS = f"""{_HITS}, p AS (SELECT group_id, max(complete_hit) FILTER (method = 0) AS a, max(complete_hit) FILTER (method = 1) AS b FROM hits GROUP BY group_id), heads AS (
    SELECT count(*) AS problems, CAST(sum(CAST(a > b AS INTEGER)) AS BIGINT) AS wins, CAST(sum(CAST(a < b AS INTEGER)) AS BIGINT) AS losses, CAST(sum(CAST(a = 1 AND b = 1 AS INTEGER)) AS BIGINT) AS "both", CAST(sum(CAST(a = 0 AND b = 0 AS INTEGER)) AS BIGINT) AS neither FROM p)"""


@query(f"WITH {_HEADS} SELECT *, round(wins / nullif(wins + losses, 0), 6) AS win_rate FROM heads", "attempts", "expected")
def head_to_head(spark, sf):
    return _rounded(compare.head_to_head(_hits(spark, sf), 0, 1))


@query(
    f"""WITH {_HEADS} SELECT *, round(wins / nullif(wins + losses, 0), 6) AS win_rate,
    round(least(1, 2 * list_sum([exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)) FOR i IN range(0, least(wins, losses) + 1)])), 6) AS p_value FROM heads""",
    "attempts", "expected",
)
def mcnemar(spark, sf):
    return _rounded(compare.mcnemar(compare.head_to_head(_hits(spark, sf), 0, 1)))


_POOL = "pool AS (SELECT *, event_type AS signature, public_metrics AS code FROM programs WHERE compile_ok = 1)"


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return views.programs(spark, sf).withColumns({"signature": F.col("event_type"), "code": F.col("public_metrics")})


@query(
    f"""WITH {_POOL}, own AS (SELECT *, min(id) OVER (PARTITION BY problem_id, signature) AS seen FROM pool
        QUALIFY row_number() OVER (PARTITION BY problem_id, signature ORDER BY semantic_ok DESC, coalesce(combined_score, 0) DESC, length(signature), length(code), id) = 1)
    SELECT problem_id, id, signature, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY semantic_ok DESC, coalesce(combined_score, 0) DESC, length(signature), length(code), seen) AS INTEGER) AS "rank" FROM own QUALIFY "rank" <= 3""",
    "programs",
)
def top_unique(spark, sf):
    return select.top_unique(_pool(spark, sf), 3).select("problem_id", "id", "signature", "rank")


@query(
    """WITH p AS (SELECT *, max(semantic_ok) OVER (PARTITION BY problem_id) AS best FROM programs WHERE compile_ok = 1)
    SELECT problem_id, id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC NULLS LAST, ts, id) AS INTEGER) AS "rank" FROM p WHERE semantic_ok = best QUALIFY "rank" <= 5""",
    "programs",
)
def semantic_pool(spark, sf):
    return select.semantic_pool(views.programs(spark, sf), 5).select("problem_id", "id", "rank")


_SLOTS = "slots AS (SELECT problem_id, id, row_number() OVER (PARTITION BY problem_id ORDER BY id) - 1 AS slot, count(*) OVER (PARTITION BY problem_id) AS m FROM programs WHERE semantic_ok = 1)"


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    return views.programs(spark, sf).where("semantic_ok = 1").select("problem_id", "id")


@query(f"WITH {_SLOTS} SELECT problem_id, id, CAST(slot AS INTEGER) AS slot, 16 // m + CAST(slot < 16 % m AS BIGINT) AS n FROM slots WHERE 16 // m + CAST(slot < 16 % m AS BIGINT) > 0", "programs")
def round_robin(spark, sf):
    return select.round_robin(_semantic(spark, sf), 16, ["id"])


@query(
    f"WITH {_SLOTS} SELECT problem_id, id, k, g FROM (SELECT problem_id, id, slot, k, unnest(range(16 // k)) AS g FROM slots CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS k)) WHERE slot < k",
    "programs",
)
def budget_sweep(spark, sf):
    ranked = select.round_robin(_semantic(spark, sf), 10**6, ["id"]).select("problem_id", "id", (F.col("slot") + 1).alias("rank"))
    return select.attempt_slots(select.budget_sweep(ranked, [1, 2, 4, 8, 16], 16)).select("problem_id", "id", F.col("k").cast("int").alias("k"), F.col("g").cast("long").alias("g"))


@query(
    """WITH t AS (SELECT *, coalesce(max(pass_ok) OVER (PARTITION BY group_id ORDER BY k_idx, part, supp, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM attempts)
    SELECT group_id, count(*) AS needed, CAST(sum(pass_ok) AS BIGINT) AS passed FROM t WHERE done = 0 GROUP BY group_id""",
    "attempts",
)
def early_stop(spark, sf):
    rows = select.before_first_success(views.attempts(spark, sf), ["group_id"], ["k_idx", "part", "supp", "price"], "pass_ok")
    return rows.groupBy("group_id").agg(F.count("*").alias("needed"), F.sum("pass_ok").alias("passed"))


@query("SELECT id, max(combined_score) OVER (PARTITION BY problem_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM programs", "programs")
def best_so_far(spark, sf):
    return select.best_so_far(views.programs(spark, sf), ["problem_id"], ["ts", "id"], "combined_score").select("id", "best_so_far")


@query(
    """WITH r AS (SELECT id, problem_id, ts, CASE WHEN compile_ok = 1 THEN sum(CASE WHEN compile_ok = 1 THEN combined_score END) OVER (PARTITION BY problem_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) END AS run FROM programs)
    SELECT id, round(first_value(run IGNORE NULLS) OVER (PARTITION BY problem_id ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS cumulative_cost FROM r""",
    "programs",
)
def cumulative_cost(spark, sf):
    p = views.programs(spark, sf).withColumn("cost", F.when(F.col("compile_ok") == 1, F.col("combined_score")))
    return select.cumulative_cost(p, ["problem_id"], ["ts", "id"], "cost").select("id", _r("cumulative_cost", 4).alias("cumulative_cost"))


@query(
    """WITH b AS (SELECT *, max(semantic_ok * 1000000.0 + combined_score) OVER (PARTITION BY problem_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM programs),
    u AS (SELECT *, sum(CAST(best IS NULL OR semantic_ok * 1000000.0 + combined_score > best AS INTEGER)) OVER (PARTITION BY problem_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS part FROM b),
    s AS (SELECT id, CAST(row_number() OVER (PARTITION BY problem_id, part ORDER BY ts, id) - 1 AS INTEGER) AS streak FROM u)
    SELECT id, streak, CAST(streak >= 5 AS INTEGER) AS stagnated FROM s""",
    "programs",
)
def stagnation(spark, sf):
    p = views.programs(spark, sf)
    return select.stagnation(p, ["problem_id"], ["ts", "id"], ["semantic_ok", "combined_score"], 5).select("id", "streak", "stagnated")


@query(
    "WITH r AS (SELECT problem_id, id, sum(compile_ok) OVER (PARTITION BY problem_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS t FROM programs) SELECT problem_id, min(id) AS stop_at, CAST(min(t) AS BIGINT) AS total FROM r WHERE t >= 20 GROUP BY problem_id",
    "programs",
)
def stop_point(spark, sf):
    return select.stop_point(views.programs(spark, sf), ["problem_id"], "id", "compile_ok", 20)


@query(
    """WITH e AS (SELECT id, problem_id, exp((combined_score - max(combined_score) OVER (PARTITION BY problem_id)) / 3.5) AS e FROM programs WHERE combined_score IS NOT NULL)
    SELECT id, round(e / sum(e) OVER (PARTITION BY problem_id), 6) AS probability FROM e""",
    "programs",
)
def softmax(spark, sf):
    return _rounded(select.softmax(views.programs(spark, sf).where("combined_score is not null"), ["problem_id"], "combined_score").select("id", "probability"))


@query(
    """WITH w AS (SELECT id, problem_id, 1.0::DOUBLE / row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, id) AS w FROM programs WHERE compile_ok = 1 AND combined_score IS NOT NULL)
    SELECT id, round(w / sum(w) OVER (PARTITION BY problem_id), 6) AS probability FROM w""",
    "programs",
)
def power_law(spark, sf):
    return _rounded(select.power_law(views.programs(spark, sf).where("compile_ok = 1 and combined_score is not null"), ["problem_id"], "combined_score", "id").select("id", "probability"))


@query(
    """WITH a AS (SELECT event_type AS arm, count(value) AS n, avg(value) AS mean FROM events GROUP BY event_type), b AS (SELECT *, mean + sqrt(2 * ln(sum(n) OVER ()) / n) AS bound FROM a), w AS (SELECT *, CAST(bound = max(bound) OVER () AS INTEGER) AS win FROM b)
    SELECT arm, n, round(mean, 6) AS mean, round(bound, 6) AS bound, round(0.8 * win / sum(win) OVER () + 0.2 / count(*) OVER (), 6) AS probability FROM w"""
)
def bandit(spark, sf):
    e = views.table(spark, sf, "events").withColumnRenamed("event_type", "arm")
    return _rounded(select.bandit(e, "arm", "value"))


@query(
    """SELECT problem_id, id FROM programs a WHERE compile_ok = 1 AND combined_score IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM programs b WHERE b.problem_id = a.problem_id AND b.compile_ok = 1 AND b.combined_score >= a.combined_score AND length(b.public_metrics) >= length(a.public_metrics)
        AND (b.combined_score > a.combined_score OR length(b.public_metrics) > length(a.public_metrics)))""",
    "programs",
)
def pareto_front(spark, sf):
    p = views.programs(spark, sf).where("compile_ok = 1 and combined_score is not null").withColumn("size", F.length("public_metrics"))
    return select.pareto_front(p, ["problem_id"], "combined_score", "size").select("problem_id", "id")


@query(
    """WITH e AS (SELECT id AS child, parent_id AS parent FROM programs p WHERE parent_id IS NOT NULL AND parent_id <> id AND parent_id IN (SELECT id FROM programs)),
    d AS (SELECT id, id AS root, 0 AS depth FROM programs WHERE id NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, d.root, d.depth + 1 FROM d JOIN e ON e.parent = d.id)
    SELECT * FROM d""",
    "programs",
)
def lineage_depths(spark, sf):
    return lineage.depths(views.programs(spark, sf))


@query("WITH e AS (SELECT parent_id, count(*) AS n FROM programs WHERE parent_id <> id GROUP BY parent_id) SELECT id, coalesce(n, 0) AS children FROM programs LEFT JOIN e ON e.parent_id = id", "programs")
def children_count(spark, sf):
    return lineage.children_count(views.programs(spark, sf)).select("id", "children")


@query(
    """WITH best AS (SELECT problem_id, id FROM programs WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, ts, id) = 1),
    r AS (SELECT problem_id, id, 0 AS steps_back FROM best UNION ALL
        SELECT r.problem_id, p.parent_id, steps_back + 1 FROM r JOIN programs p ON p.id = r.id WHERE p.parent_id IS NOT NULL AND p.parent_id <> p.id AND p.parent_id IN (SELECT id FROM programs))
    SELECT * FROM r""",
    "programs",
)
def path_to_best(spark, sf):
    p = views.programs(spark, sf)
    return lineage.path_to_best(p, select.best_program(p))


@query(
    """WITH best AS (SELECT problem_id, id FROM programs WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, ts, id) = 1),
    r AS (SELECT problem_id, id, 0 AS back FROM best UNION ALL
        SELECT r.problem_id, p.parent_id, back + 1 FROM r JOIN programs p ON p.id = r.id WHERE p.parent_id IS NOT NULL AND p.parent_id <> p.id AND p.parent_id IN (SELECT id FROM programs)),
    s AS (SELECT r.problem_id, CAST(max(back) OVER (PARTITION BY r.problem_id) - back AS INTEGER) AS step, r.id, p.event_type AS a, coalesce(p.public_metrics, '') AS b FROM r JOIN programs p ON p.id = r.id),
    c AS (SELECT s.*, CAST(s.a <> q.a AS BIGINT) + CAST(s.b <> q.b AS BIGINT) AS n FROM s LEFT JOIN s q ON q.problem_id = s.problem_id AND q.step = s.step - 1)
    SELECT problem_id, step, id, 'theorem' || chr(10) || a || chr(10) || b || chr(10) || 'end' AS code, n AS added, n AS removed FROM c""",
    "programs",
)
def path_steps(spark, sf):
    p = views.programs(spark, sf)
    code = F.concat_ws("\n", F.lit("theorem"), "event_type", F.coalesce("public_metrics", F.lit("")), F.lit("end"))
    return lineage.path_steps(p.withColumn("code", code), select.best_program(p)).drop("patch")


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id)
    SELECT query_id, id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS "rank" FROM s QUALIFY "rank" <= 5"""
)
def most_similar(spark, sf):
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("island_idx"), "embedding")
    return _rounded(vectors.most_similar(e, e, 5))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id)
    SELECT query_id, id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS "rank" FROM s QUALIFY "rank" <= 3"""
)
def nearest_neighbours(spark, sf):
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _rounded(vectors.most_similar(e, e, 3, group=None))


@query(
    """SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 20 = 0"""
)
def island_similarities(spark, sf):
    """Every 20th row against its whole island."""
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("island_idx"), "embedding")
    return _rounded(vectors.similarities(e.where("id % 20 = 0"), e))


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS similarity FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id < q.vec_id GROUP BY 1)
    SELECT vec_id AS query_id, round(similarity, 6) AS similarity, CAST(coalesce(similarity <= 0.5, true) AS INTEGER) AS novel FROM embeddings LEFT JOIN s ON query_id = vec_id"""
)
def novelty(spark, sf):
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("island_idx"), "embedding")
    return _rounded(vectors.novelty(e, e, 0.5))


@query("SELECT round(coalesce(corr(n_chars, quality), 0), 6) AS r, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_if_1, round(avg(n_chars) FILTER (quality = 0), 6) AS mean_if_0 FROM labels JOIN documents USING (doc_id)")
def outcome_correlation(spark, sf):
    return _rounded(compare.pearson(views.table(spark, sf, "labels").join(views.table(spark, sf, "documents"), "doc_id"), "n_chars", "quality"))


@query(
    f"""WITH {_PROBLEMS}, d AS (SELECT a.semantic_density AS x, b.semantic_density AS y FROM problems a JOIN problems b ON a.problem_id = b.problem_id WHERE a.method = 0 AND b.method = 1)
    SELECT count(*) AS problems, CAST(sum(CAST(x > y AS INTEGER)) AS BIGINT) AS wins, CAST(sum(CAST(x < y AS INTEGER)) AS BIGINT) AS losses, CAST(sum(CAST(x = y AS INTEGER)) AS BIGINT) AS ties, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(x - y), 6) AS mean_difference FROM d""",
    "programs", "terminations",
)
def paired_density(spark, sf):
    return _rounded(compare.paired_density(_problems(spark, sf), 0, 1))


@query(
    f"""WITH {_PROBLEMS}, d AS (SELECT a.semantic_density AS a, b.semantic_density AS b FROM problems a JOIN problems b ON a.problem_id = b.problem_id WHERE a.method = 0 AND b.method = 1),
    long AS (SELECT 'a' AS side, a AS x FROM d UNION ALL SELECT 'b', b FROM d UNION ALL SELECT 'difference', a - b FROM d),
    r AS (SELECT side, x, row_number() OVER (PARTITION BY side ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM long)
    SELECT side, count(*) AS n, round(avg(x), 6) AS mean, CASE side WHEN 'difference' THEN CAST(sum(CAST(x > 0 AS INTEGER)) AS BIGINT) END AS wins, CASE side WHEN 'difference' THEN CAST(sum(CAST(x < 0 AS INTEGER)) AS BIGINT) END AS losses, CASE side WHEN 'difference' THEN CAST(sum(CAST(x = 0 AS INTEGER)) AS BIGINT) END AS ties,
    round(max(x) FILTER (i = round_even(0.25 * (n - 1), 0)), 6) AS p25, round(max(x) FILTER (i = CASE side WHEN 'difference' THEN n // 2 ELSE round_even(0.5 * (n - 1), 0) END), 6) AS p50, round(max(x) FILTER (i = round_even(0.75 * (n - 1), 0)), 6) AS p75, round(max(x) FILTER (i = round_even(0.9 * (n - 1), 0)), 6) AS p90
    FROM r GROUP BY side""",
    "programs", "terminations",
)
def paired_report(spark, sf):
    return _rounded(compare.paired_report(_problems(spark, sf), 0, 1))


@query(
    """SELECT problem_id, id FROM programs a WHERE compile_ok = 1 AND combined_score IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM programs b WHERE b.problem_id = a.problem_id AND b.compile_ok = 1 AND b.combined_score >= a.combined_score AND length(b.public_metrics) <= length(a.public_metrics)
        AND (b.combined_score > a.combined_score OR length(b.public_metrics) < length(a.public_metrics)))""",
    "programs",
)
def short_and_good(spark, sf):
    """The front of greater scores and shorter texts."""
    p = views.programs(spark, sf).where("compile_ok = 1 and combined_score is not null").withColumn("size", F.length("public_metrics"))
    return select.pareto_front(p, ["problem_id"], "combined_score", "size", more_y=False).select("problem_id", "id")


@query(
    """SELECT problem_id, min(id) AS id, count(*) AS copies FROM (SELECT problem_id, id, trim(regexp_replace(split_part(code, 'theorem t' || id || ' ', 2), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS own FROM candidates) GROUP BY problem_id, own""",
    "candidates",
)
def duplicate_candidates(spark, sf):
    """Candidates of a problem that differ in the name alone."""
    return metrics.exact_duplicates(views.candidates(spark, sf), ["problem_id"])


@query("SELECT id, compile_ok = 1 AND semantic_ok = 1 AS soft, compile_ok = 1 AND island_idx = 1 AS strict FROM programs", "programs")
def successes(spark, sf):
    p = views.programs(spark, sf)
    return p.select("id", metrics.soft_success(F.col("compile_ok"), F.col("semantic_ok")).alias("soft"), metrics.strict_success(F.col("compile_ok"), F.col("island_idx")).alias("strict"))


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    p = _problems(spark, sf)
    own = lambda m, n: p.where(F.col("method") == m).select("problem_id", F.col("semantic_density").alias(n))
    return own(0, "x").join(own(1, "y"), "problem_id").select("problem_id", (F.col("x") - F.col("y")).alias("d"))


@query(None)
def sign_flip_test(spark, sf):
    return resampling.sign_flip_p(_differences(spark, sf))


@query(None)
def bootstrap_interval(spark, sf):
    return resampling.bootstrap_ci(_differences(spark, sf))


@query(
    "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS isle FROM d) SELECT l_orderkey, min(l_linenumber) AS \"first\", max(l_linenumber) AS \"last\" FROM i GROUP BY l_orderkey, isle"
)
def present_ranges(spark, sf):
    return metrics.compress_ranges(views.table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem), m AS (SELECT k, unnest(range(9)) AS i FROM (SELECT DISTINCT k FROM p) EXCEPT SELECT * FROM p),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS isle FROM m) SELECT k AS l_orderkey, CAST(min(i) AS INTEGER) AS "first", CAST(max(i) AS INTEGER) AS "last" FROM g GROUP BY k, isle"""
)
def missing_ranges(spark, sf):
    rows = views.table(spark, sf, "lineitem").withColumn("until", F.lit(9))
    return metrics.missing_ranges(rows, ["l_orderkey"], "l_linenumber", "until")


@query(
    """SELECT l_returnflag AS kind, count(*) AS queries, round(sum(coalesce(price, 0) * l_quantity), 2) AS cost, CAST(sum(CAST(price IS NULL AS INTEGER)) AS BIGINT) AS unknown_models
    FROM lineitem LEFT JOIN (SELECT p_partkey, p_retailprice AS price FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY l_returnflag"""
)
def query_costs(spark, sf):
    prices = views.table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    log = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "kind")
    return metrics.query_costs(log, prices, ["kind"], "l_partkey", "l_quantity").withColumn("cost", _r(F.col("cost"), 2))


@query(
    """WITH p AS (SELECT trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS folded, doc_id FROM documents) SELECT min(doc_id) AS id, count(*) AS copies FROM p GROUP BY folded"""
)
def exact_duplicates(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.groupBy(F.sha2(T.folded(F.col("text")), 256).alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).drop("key")


@query(
    "SELECT CAST(group_id AS VARCHAR) AS \"group\", CAST(method AS VARCHAR) AS method, k_idx AS k, CAST(supp AS INTEGER) AS g, count(*) AS n FROM attempts GROUP BY ALL",
    "attempts",
)
def attempt_ids(spark, sf):
    a = views.attempts(spark, sf)
    name = F.concat(T.attempt_id(F.col("group_id"), F.col("method"), F.col("k_idx")), F.lit("_g"), F.col("supp").cast("string"))
    return a.select(T.attempt_parts(name).alias("p")).groupBy("p.group", "p.method", "p.k", "p.g").agg(F.count("*").alias("n"))


@query(None)
def bounded_archive(spark, sf):
    p = views.programs(spark, sf)
    return archive.batch_archive(p.select(F.col("problem_id").alias("run_id"), "id", F.col("id").alias("seq"), F.col("public_metrics").alias("key"), F.coalesce("combined_score", F.lit(0.0)).alias("score"), F.col("compile_ok").alias("correct")), 10)


_KEYED = """keyed AS (SELECT method, problem_id, CAST(id % 7 <> 0 AS INTEGER) AS compile_ok, CAST(id % 3 = 0 AS INTEGER) AS semantic_ok, split_part(code, 'theorem t' || id || ' : ', 2) AS statement FROM candidates)"""


@query(
    f"""WITH {_KEYED}, own AS (SELECT method, problem_id, max(compile_ok) AS hit, count(DISTINCT statement) FILTER (compile_ok = 1 AND semantic_ok = 1) AS n FROM keyed GROUP BY ALL)
    SELECT method, count(*) AS problems, round(avg(hit), 6) AS compile_hit_rate, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS semantic_hit_rate, CAST(sum(n) AS BIGINT) AS semantic_statements, min(n) AS least, max(n) AS most FROM own GROUP BY method""",
    "candidates",
)
def statement_metrics(spark, sf):
    c = views.candidates(spark, sf).withColumns({"compile_ok": (F.col("id") % 7 != 0).cast("int"), "semantic_ok": (F.col("id") % 3 == 0).cast("int")})
    return _rounded(metrics.statement_metrics(c, T.canonical_statement(F.col("code"))))


@query(
    f"""WITH {_PROBLEMS}, sig AS (SELECT method, problem_id, kind, event_type, count(*) AS c FROM (SELECT *, 'compile' AS kind FROM programs WHERE compile_ok = 1 UNION ALL SELECT *, 'semantic' FROM programs WHERE semantic_ok = 1) GROUP BY ALL),
    own AS (SELECT method, problem_id, kind, count(*) AS n, max(c) AS most FROM sig GROUP BY ALL),
    long AS (SELECT method, problem_id, calls, 'compile' AS kind, compile_count AS ok, compile_hit AS hit, compile_density AS density FROM problems UNION ALL SELECT method, problem_id, calls, 'semantic', semantic_count, semantic_hit, semantic_density FROM problems),
    t AS (SELECT l.method, l.kind, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(ok) AS BIGINT) AS ok, CAST(sum(calls) AS BIGINT) AS calls, sum(density) AS d, CAST(sum(coalesce(n, 0)) AS BIGINT) AS signatures, max(coalesce(most, 0)) AS most_copies
        FROM long l LEFT JOIN own o ON o.method = l.method AND o.problem_id = l.problem_id AND o.kind = l.kind GROUP BY ALL), declared AS (SELECT count(*) AS n FROM terminations)
    SELECT method, kind, hit, ok, calls, signatures, most_copies, round(hit / n, 6) AS hit_rate, round(coalesce(ok / nullif(calls, 0), 0), 6) AS density, round(d / n, 6) AS density_mean, round(coalesce(signatures / nullif(calls, 0), 0), 6) AS signature_density FROM t CROSS JOIN declared""",
    "programs", "terminations",
)
def method_summary(spark, sf):
    pool = _pool(spark, sf)
    own = [metrics.signature_diversity(pool.where(f"{k}_ok = 1"), ["method", "problem_id"]).withColumn("kind", F.lit(k)) for k in ("compile", "semantic")]
    diversity = own[0].union(own[1]).select("method", "problem_id", "kind", "distinct_signatures", "top_count")
    return _rounded(metrics.method_summary(_problems(spark, sf), diversity, views.terminations(spark, sf).count()))


@query(
    "SELECT problem_id, method, id FROM programs QUALIFY row_number() OVER (PARTITION BY problem_id, method ORDER BY combined_score DESC NULLS LAST, semantic_ok DESC, compile_ok DESC, length(event_type) NULLS FIRST, length(public_metrics) NULLS FIRST, id) = 1",
    "programs",
)
def best_case(spark, sf):
    return select.best_case(_pool(spark, sf), ["problem_id", "method"]).select("problem_id", "method", "id")


@query("SELECT id, combined_score FROM programs WHERE compile_ok = 1 AND combined_score IS NOT NULL ORDER BY combined_score DESC, id LIMIT 25", "programs")
def top_programs(spark, sf):
    return select.top_programs(views.programs(spark, sf), 25, correct_only=True).select("id", "combined_score")


@query(
    "WITH a AS (SELECT id AS kept FROM programs WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, ts, id) = 1) SELECT id, problem_id, CAST(kept IS NOT NULL AS INTEGER) AS in_archive FROM programs LEFT JOIN a ON kept = id",
    "programs",
)
def archive_flags(spark, sf):
    p = views.programs(spark, sf)
    return select.with_archive_flag(p, select.best_program(p)).select("id", "problem_id", "in_archive")


@query(
    "WITH a AS (SELECT c_mktsegment AS theorem, count(*) AS answers FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT c_custkey AS run, c_mktsegment AS theorem, answers FROM customer LEFT JOIN a ON theorem = c_mktsegment"
)
def known_answers(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), "c_mktsegment")
    answers = c.where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_mktsegment").alias("theorem")).agg(F.count("*").alias("answers"))
    name = T.theorem_key(F.concat(F.lpad(F.col("run").cast("string"), 6, "0"), F.lit("_"), "c_mktsegment"))
    return select.with_answers(c, answers, name).select("run", "theorem", "answers")


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""WITH d AS (SELECT doc_id, trim(list_aggregate(list_filter(string_split(regexp_replace(coalesce(text, ''), '(?s)/-.*?-/', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^[ \\t\\x0B\\f\\r]*--')), 'string_agg', chr(10)), {_WHITE}) AS code FROM documents),
    s AS (SELECT item_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\bsorry\\b', '', 'g'), {_WHITE})), lambda x: x <> '' AND NOT regexp_matches(x, '^(import|set_option|open)')) AS chunks FROM benchmark),
    j AS (SELECT doc_id, coalesce(code, '') AS code, len(list_filter(coalesce(chunks, []), lambda c: NOT contains(coalesce(d.code, ''), c))) AS missing FROM d LEFT JOIN s ON item_id = doc_id % 40)
    SELECT doc_id, CASE WHEN code = '' THEN 'empty' WHEN contains(code, 'license') THEN 'forbidden: license' WHEN contains(code, 'axiom') THEN 'forbidden: axiom' WHEN missing > 0 THEN 'missing chunks: ' || missing ELSE '' END AS reason FROM j"""
)
def precheck(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    s = views.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("statement"))
    return d.join(s, "item_id", "left").select("doc_id", T.precheck(F.col("text"), F.col("statement"), ["license", "axiom"])["reason"].alias("reason"))

"""Registered queries over populations of candidates: order, probabilities, inspirations, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.operators import bandits, lineage, metrics, select, vectors
from lemmaflow.operators import population as G
from lemmaflow.plans import views
from lemmaflow.plans.queries import _rounded, query
from lemmaflow.streaming import results

_METRIC = "CAST(json_extract_string(public_metrics, '$.k') AS DOUBLE)"
_BETTER = f"compile_ok DESC, combined_score DESC NULLS LAST, {_METRIC} DESC NULLS LAST, ts DESC, id"


@query(f"SELECT problem_id, id FROM programs QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY {_BETTER}) = 1", "programs")
def best_overall(spark, sf):
    return G.best_overall(views.programs(spark, sf), ["problem_id"]).select("problem_id", "id")


@query("SELECT island_idx, count(*) AS population FROM programs WHERE island_idx IS NOT NULL GROUP BY island_idx", "programs")
def island_sizes(spark, sf):
    return G.island_sizes(views.programs(spark, sf))


@query(
    """WITH c AS (SELECT l_shipdate, l_returnflag AS k, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem), n AS (SELECT k, low, high, count(*) AS n FROM c GROUP BY ALL)
    SELECT k, low, high, n, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, low, high) AS INTEGER) AS "rank", count(*) OVER (PARTITION BY k) AS pairs FROM n QUALIFY "rank" <= 3"""
)
def parent_pairs(spark, sf):
    return G.parent_pairs(views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k"), ["k"], "l_partkey", "l_suppkey")


@query('SELECT id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY ts, id) AS INTEGER) AS "count" FROM programs QUALIFY "count" % 10 = 0', "programs")
def every_tenth(spark, sf):
    return G.every_n(views.programs(spark, sf), ["problem_id"], ["ts", "id"], 10).select("id", "count")


@query(
    "SELECT problem_id, count(*) AS programs, max(combined_score) AS best_score, arg_min(id, (-combined_score, ts, id)) FILTER (combined_score IS NOT NULL) AS best_id, max(compile_ok) AS compile_hit, max(semantic_ok) AS semantic_hit FROM programs GROUP BY problem_id",
    "programs",
)
def strict_rows(spark, sf):
    return metrics.strict_rows(views.programs(spark, sf))


@query("WITH b AS (SELECT max(combined_score) AS s FROM programs GROUP BY problem_id) SELECT CAST(trunc(s) AS BIGINT) AS score, count(*) AS n FROM b WHERE s IS NOT NULL GROUP BY 1", "programs")
def best_score_histogram(spark, sf):
    return metrics.score_histogram(metrics.strict_rows(views.programs(spark, sf)), "best_score")


@query(
    f"""SELECT method, count(*) AS programs, round(sum(coalesce({_METRIC}, 0)), 4) AS k, round(avg(combined_score), 6) AS mean_score, round(max(combined_score), 6) AS best_score, round(median(combined_score), 6) AS median_score,
    round(avg(compile_ok), 6) AS correct_share, round(sum(coalesce({_METRIC}, 0)) / count(*), 6) AS cost_per_program FROM programs GROUP BY method""",
    "programs",
)
def cost_summary(spark, sf):
    p = views.programs(spark, sf).withColumns({"metadata": F.col("public_metrics"), "correct": F.col("compile_ok")})
    return _rounded(metrics.cost_summary(p, ["k"], ["method"]))


_CHILDREN = "kids AS (SELECT parent_id AS id, count(*) AS children FROM programs WHERE parent_id <> id GROUP BY parent_id), family AS (SELECT p.*, coalesce(children, 0) AS children FROM programs p LEFT JOIN kids USING (id))"


def _family(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.children_count(views.programs(spark, sf))


@query(
    f"""WITH {_CHILDREN}, x AS (SELECT id, problem_id, CASE WHEN semantic_ok = 1 THEN -combined_score / 100 / 3.5 - ln(1 + 0.05 * children) END AS x FROM family WHERE compile_ok = 1), w AS (SELECT *, coalesce(exp(x - max(x) OVER (PARTITION BY problem_id)), 0) AS w FROM x),
    s AS (SELECT *, sum(w) OVER (PARTITION BY problem_id) AS s, count(*) OVER (PARTITION BY problem_id) AS n FROM w) SELECT id, round(CASE WHEN s > 0 THEN w / s ELSE 1 / n END, 6) AS probability FROM s""",
    "programs",
)
def cycle_softmax(spark, sf):
    p = _family(spark, sf).where("compile_ok = 1").withColumn("log_prob", F.when(F.col("semantic_ok") == 1, -F.col("combined_score") / 100))
    return _rounded(G.cycle_softmax(p, ["problem_id"], "log_prob", "children").select("id", "probability"))


@query(
    f"""WITH {_CHILDREN}, t AS (SELECT *, max(combined_score) OVER (PARTITION BY problem_id) AS m FROM family WHERE compile_ok = 1 AND combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, id) <= 10),
    w AS (SELECT id, problem_id, exp(3 * CASE WHEN m > 0 THEN combined_score / m ELSE 0 END) * exp(-0.3 * children) AS w FROM t) SELECT id, round(w / sum(w) OVER (PARTITION BY problem_id), 6) AS probability FROM w""",
    "programs",
)
def archive_weights(spark, sf):
    p = _family(spark, sf).where("compile_ok = 1 and combined_score is not null")
    return _rounded(G.archive_weights(p, ["problem_id"], "combined_score", "children", ["id"]).select("id", "probability"))


@query(
    f"""WITH {_CHILDREN}, c AS (SELECT * FROM family WHERE compile_ok = 1 AND combined_score IS NOT NULL), m AS (SELECT problem_id, median(combined_score) AS m FROM c GROUP BY problem_id), d AS (SELECT problem_id, median(abs(combined_score - m)) AS s FROM c JOIN m USING (problem_id) GROUP BY problem_id),
    w AS (SELECT id, problem_id, 1 / (1 + exp(-10 * (combined_score - m) / greatest(s, 1e-6))) / (1 + 2 * children) AS w FROM c JOIN m USING (problem_id) JOIN d USING (problem_id)) SELECT id, round(w / sum(w) OVER (PARTITION BY problem_id), 6) AS probability FROM w""",
    "programs",
)
def weighted_parents(spark, sf):
    p = _family(spark, sf).where("compile_ok = 1 and combined_score is not null")
    return _rounded(select.weighted(p, ["problem_id"], "combined_score", "children").select("id", "probability"))


@query(None)
def drawn_parents(spark, sf):
    p = select.power_law(views.programs(spark, sf).where("compile_ok = 1 and combined_score is not null"), ["problem_id"], "combined_score", "id")
    first = G.draw(p, ["problem_id"], "probability", 1, seed=7)
    return G.second_parents(p, first, ["problem_id"], "combined_score", seed=8)


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    return select.best_program(views.programs(spark, sf))


@query(None)
def inspirations(spark, sf):
    return G.inspirations(_parents(spark, sf), views.programs(spark, sf), 5)


@query(
    """WITH parent AS (SELECT problem_id, id AS parent FROM programs WHERE combined_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY combined_score DESC, ts, id) = 1),
    out_ AS (SELECT problem_id, min(id) AS id FROM programs WHERE compile_ok = 1 GROUP BY problem_id),
    c AS (SELECT p.problem_id, parent, p.id, coalesce(combined_score, CAST(json_extract_string(public_metrics, '$.k') AS DOUBLE), '-infinity') AS v FROM programs p JOIN parent USING (problem_id) LEFT JOIN out_ o ON o.problem_id = p.problem_id AND o.id = p.id WHERE compile_ok = 1 AND p.id <> parent AND o.id IS NULL)
    SELECT problem_id, parent, id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY v DESC, id) AS INTEGER) AS place FROM c QUALIFY place <= 3""",
    "programs",
)
def top_inspirations(spark, sf):
    p, parents = views.programs(spark, sf), _parents(spark, sf)
    first = p.where("compile_ok = 1").groupBy("problem_id").agg(F.min("id").alias("id"))
    out = parents.select("problem_id", F.col("id").alias("parent")).join(first, "problem_id").select("parent", "id")
    return G.top_inspirations(parents, p, out, 3)


@query(None)
def migration_plan(spark, sf):
    return select.migration_plan(views.programs(spark, sf))


@query(f"SELECT problem_id, id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY {_BETTER}) = 1 AS INTEGER) AS is_best FROM programs WHERE parent_id IS NOT NULL", "programs")
def without_seeds(spark, sf):
    name = F.when(F.col("parent_id").isNull(), F.concat(F.lit("initial_program_"), F.col("id").cast("string"))).otherwise("patch")
    return G.without_seeds(views.programs(spark, sf).withColumn("patch_name", name)).select("problem_id", "id", "is_best")


@query(
    f"""WITH kids AS (SELECT parent_id AS id, count(*) AS n FROM programs WHERE parent_id IS NOT NULL GROUP BY parent_id), now AS (SELECT problem_id, min(p.id) AS id FROM programs p GROUP BY problem_id),
    best AS (SELECT problem_id, id FROM programs WHERE compile_ok = 1 QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY {_BETTER}) = 1)
    SELECT b.problem_id, CASE WHEN coalesce(k.n, 0) < 2 THEN now.id ELSE b.id END AS parent FROM best b LEFT JOIN now USING (problem_id) LEFT JOIN kids k ON k.id = now.id""",
    "programs",
)
def next_beam_parent(spark, sf):
    p = views.programs(spark, sf)
    return G.next_beam_parent(p, p.groupBy("problem_id").agg(F.min("id").alias("id")), 2)


@query(
    """WITH l AS (SELECT user_id AS bandit, event_type AS arm, greatest(coalesce(value - 10, 0), 0) AS gain, pow(0.95, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)) AS w FROM events)
    SELECT bandit, arm, round(sum(w), 6) AS pulls, round(sum(w * gain), 6) AS total FROM l GROUP BY bandit, arm"""
)
def bandit_state(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("bandit"), F.col("event_id").alias("seq"), F.col("event_type").alias("arm"), G.gain(F.col("value"), F.lit(10.0)).alias("gain"))
    return _rounded(G.bandit_fold(e))


@query(
    """WITH RECURSIVE l AS (SELECT user_id AS bandit, event_type AS arm, CASE WHEN value > 10 THEN (value - 10) * 3 + ln(1 - exp((10 - value) * 3)) END AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    step AS (SELECT DISTINCT bandit, arm, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS pulls, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS top FROM l
        UNION ALL
        SELECT bandit, arm, n, pulls, s, CASE WHEN top IS NOT NULL THEN greatest(ln(0.95) - CASE WHEN top > 0 THEN ln(0.05 + exp(-top)) ELSE ln(1 + 0.05 * exp(top)) - top END, max(s - ln(greatest(pulls, 1e-7))) OVER (PARTITION BY bandit)) END FROM (
            SELECT bandit, arm, n, pulls, ln(0.95) - CASE WHEN s > 0 THEN ln(0.05 + exp(-s)) ELSE ln(1 + 0.05 * exp(s)) - s END AS s, top FROM (
                SELECT step.bandit, step.arm, l.n, 0.95 * (pulls + CAST(l.arm = step.arm AS INTEGER)) AS pulls, greatest(top, l.g) AS top,
                       CASE WHEN l.arm = step.arm AND g IS NOT NULL THEN coalesce(greatest(s, g) + ln(1 + exp(-abs(s - g))), g) ELSE s END AS s
                FROM step JOIN l ON l.bandit = step.bandit AND l.n = step.n + 1)))
    SELECT bandit, arm, round(pulls, 6) AS pulls, round(s, 6) AS log_total, round(top, 6) AS log_range FROM step QUALIFY n = max(n) OVER (PARTITION BY bandit)"""
)
def bandit_log_state(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("bandit"), F.col("event_id").alias("seq"), F.col("event_type").alias("arm"), (G.gain(F.col("value"), F.lit(10.0)) * 3).alias("gain"))
    totals = bandits.bandit_log_totals(e)
    some = lambda c: F.when(F.col(c) > bandits.NONE, F.col(c))
    return _rounded(totals.withColumns({c: some(c) for c in ("log_total", "log_range")}))


@query(
    """WITH f AS (SELECT user_id AS run_id, props AS text, arg_min(length(props) + value, event_id) AS reward, min(event_id) AS seq FROM events GROUP BY ALL)
    SELECT run_id, text, round(reward, 6) AS reward, seq FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY reward DESC, seq) <= 5"""
)
def text_archive(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("props").alias("text"), (F.length("props") + F.col("value")).alias("reward"))
    return _rounded(results.batch_text_archive(e, 5))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("island_idx"), "embedding")


@query(
    """WITH s AS (SELECT a.label AS island_idx, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT island_idx, a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3"""
)
def similar_pairs(spark, sf):
    return _rounded(vectors.similar_pairs(_vectors(spark, sf), 0.3))


@query(None)
def principal_components(spark, sf):
    return vectors.principal_components(_vectors(spark, sf), 3)


@query(None)
def vector_clusters(spark, sf):
    return vectors.clusters(_vectors(spark, sf))

"""Domain views over the driver's tables: candidate programs, attempts, skeletons and the like.

Each view has a SQL twin (in SQL_VIEWS) that DuckDB can read, so that queries and their oracles
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each candidate: its problem, method, island, flags, score and metrics JSON."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("problem_id"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("method"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("island_idx"),
        "ts",
        F.col("value").alias("combined_score"),
        F.col("props").alias("public_metrics"),
        (F.col("event_type") != "error").cast("int").alias("compile_ok"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("semantic_ok"),
        "event_type",
        F.when(F.col("event_id") % 3 != 0, F.expr("event_id div 3")).alias("parent_id"),
    )


def terminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded calls of a run; zero and below fall back to the budget."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("problem_id"), F.floor("c_acctbal").cast("int").alias("calls"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("no_llm"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof attempts: group, method, statement number, outcome flags."""
    li = table(spark, sf_dir, "lineitem")
    ok = F.col("l_returnflag") != "N"
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        F.pmod("l_suppkey", F.lit(4)).cast("int").alias("method"),
        F.col("l_linenumber").cast("int").alias("k_idx"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        ok.cast("int").alias("pass_ok"),
        (ok & (F.col("l_linestatus") == "F")).cast("int").alias("complete_ok"),
    )


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable denominator: every problem that should have attempts."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("suite"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate source text, made of whole documents."""
    d = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("import Mathlib\n\n-- "), F.col("source"), F.lit("\ntheorem t"), F.col("doc_id").cast("string"), F.lit(" : "), F.regexp_replace("text", r"\s+", " "), F.lit(" := by sorry\n"))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("problem_id"), F.col("lang").alias("method"), F.col("n_chars").cast("double").alias("combined_score"), code.alias("code"))


#: The same views for DuckDB, as common table expressions.
SQL_VIEWS = {
    "programs": """programs AS (
        SELECT event_id AS id, user_id AS problem_id, CAST(event_id % 4 AS INTEGER) AS method, CAST(user_id % 4 AS INTEGER) AS island_idx,
               ts, value AS combined_score, props AS public_metrics,
               CAST(event_type <> 'error' AS INTEGER) AS compile_ok, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS semantic_ok, event_type,
               CASE WHEN event_id % 3 <> 0 THEN event_id // 3 END AS parent_id
        FROM events)""",
    "terminations": """terminations AS (
        SELECT c_custkey AS problem_id, CAST(floor(c_acctbal) AS INTEGER) AS calls, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS no_llm FROM customer)""",
    "attempts": """attempts AS (
        SELECT l_orderkey AS group_id, CAST(l_suppkey % 4 AS INTEGER) AS method, CAST(l_linenumber AS INTEGER) AS k_idx, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price,
               CAST(l_returnflag <> 'N' AS INTEGER) AS pass_ok, CAST(l_returnflag <> 'N' AND l_linestatus = 'F' AS INTEGER) AS complete_ok
        FROM lineitem)""",
    "expected": """expected AS (SELECT o_orderkey AS group_id, o_orderpriority AS suite FROM orders)""",
    "candidates": """candidates AS (
        SELECT doc_id AS id, source AS problem_id, lang AS method, CAST(n_chars AS DOUBLE) AS combined_score,
               'import Mathlib' || chr(10) || chr(10) || '-- ' || source || chr(10) || 'theorem t' || doc_id || ' : ' || regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') || ' := by sorry' || chr(10) AS code
        FROM documents)""",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views in front of it; sql starts with WITH or SELECT."""
    head = ",\n".join(SQL_VIEWS[n] for n in names)
    body = sql.strip()
    return f"WITH RECURSIVE {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"

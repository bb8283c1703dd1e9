"""Lineage of candidates: roots, depths, and the path to a problem's best candidate."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lemmaflow.operators.rounds import written


def edges(programs: DataFrame) -> DataFrame:
    """(child, parent), without self-loops and parents that are not there."""
    own = programs.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent is not null and parent <> child")
    return own.join(programs.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent")


def _rounds(n: int) -> int:
    """Doubling rounds after which every chain of n rows has come to its end; what still moves is a cycle."""
    return math.ceil(math.log2(max(n, 2))) + 1


def depths(programs: DataFrame) -> DataFrame:
    """(id, root, depth) by pointer doubling: each round a row that has not reached a root takes over
    its target's pointer, so a chain of any length n takes log2(n) rounds; each round is written out.
    Cycles, which no root reaches, are left out."""
    e = edges(programs).withColumnRenamed("child", "id")
    start = programs.select("id").join(e, "id", "left").select("id", F.coalesce("parent", "id").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"))
    up = written(start.withColumn("done", F.col("depth") == 0))
    for _ in range(_rounds(up.count())):
        if up.where("not done").isEmpty():
            break
        far = up.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = up.where("not done").join(far, "root").select("id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") == 0).alias("done"))
        up = written(up.where("done").unionByName(moved))
    return up.where("done").select("id", "root", F.col("depth").cast("int").alias("depth"))


def path_to_best(programs: DataFrame, best: DataFrame) -> DataFrame:
    """(problem_id, id, steps_back): the best candidate of each problem and all its ancestors. Round k
    adds, for every row found so far, its ancestor 2 ** k steps further back, so a path of any length n
    takes log2(n) rounds, for all problems at once. A path that runs into a cycle has each row once."""
    up = written(edges(programs).select(F.col("child").alias("id"), F.col("parent").alias("to")))
    out, hops = written(best.select("problem_id", "id", F.lit(0).alias("steps_back"))), 1
    for _ in range(_rounds(up.count())):
        more = out.join(up, "id").select("problem_id", F.col("to").alias("id"), (F.col("steps_back") + hops).alias("steps_back"))
        if more.isEmpty():
            break
        out = written(out.unionByName(more))
        hops *= 2
        up = written(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
    return out.groupBy("problem_id", "id").agg(F.min("steps_back").alias("steps_back"))


_CHANGE = StructType([StructField("patch", StringType()), StructField("added", LongType()), StructField("removed", LongType())])


def line_change(before: str | None, after: str | None) -> tuple[str | None, int | None, int | None]:
    """The unified diff of two texts' lines and how many lines it adds and removes; nothing without a text before."""
    if before is None or after is None:
        return None, None, None
    rows = list(difflib.unified_diff(before.splitlines(), after.splitlines(), "before", "after", lineterm=""))
    body = rows[2:]
    return "\n".join(rows), sum(r.startswith("+") for r in body), sum(r.startswith("-") for r in body)


def path_steps(programs: DataFrame, best: DataFrame, code: str = "code") -> DataFrame:
    """(problem_id, step, id, code, patch, added, removed): the path to each problem's best candidate in the order of time, from its
    oldest ancestor (step 0) on, with what each step changed in the lines of its parent's code; a first step changed nothing. A path
    that ran into a cycle begins with the row that closes it."""
    path = written(path_to_best(programs, best))
    first = path.groupBy("problem_id").agg(F.max("steps_back").alias("_n"))
    own = path.join(first, "problem_id").select("problem_id", "id", (F.col("_n") - F.col("steps_back")).alias("step"))
    own = written(own.join(programs.select("id", F.col(code).alias("code")), "id"))
    before = own.select("problem_id", (F.col("step") + 1).alias("step"), F.col("code").alias("_before"))

    def changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_change(x, y) for x, y in zip(a, b)], columns=_CHANGE.names).astype({"added": "Int64", "removed": "Int64"})

    change = F.pandas_udf(changes, _CHANGE)
    return own.join(before, ["problem_id", "step"], "left").withColumn("_c", change("_before", "code")).select("problem_id", "step", "id", "code", "_c.patch", "_c.added", "_c.removed")


def children_count(programs: DataFrame) -> DataFrame:
    counts = edges(programs).groupBy("parent").agg(F.count("*").alias("children"))
    return programs.join(counts.withColumnRenamed("parent", "id"), "id", "left").fillna(0, ["children"])


def depth_counts(programs: DataFrame) -> DataFrame:
    """(depth, rows): how many candidates stand at each depth below a root."""
    return depths(programs).groupBy("depth").agg(F.count("*").alias("rows"))

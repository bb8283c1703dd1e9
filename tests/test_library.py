"""Text functions, statistics, archives and lineage on hand-worked rows; queries against their SQL."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lemmaflow.functions import text as T
from lemmaflow.operators import compare, lineage, metrics, select, vectors
from lemmaflow.plans import catalog
from lemmaflow.streaming import archive

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


def test_signatures_and_keys(spark):
    code = "-- note\nimport Mathlib\nimport Aesop\n\ntheorem my_theorem : True := by sorry\n"
    assert one(spark, code, T.signature) == "theorem _ : True"
    assert one(spark, "theorem f2 (n : Nat) : n + 0 = n := by sorry", T.signature) == "theorem _ (n : Nat) : n + 0 = n"
    assert one(spark, "theorem a : True := by sorry", T.exact_key) == one(spark, "lemma  other :\n True := by sorry", T.exact_key)
    assert one(spark, code, T.exact_key) != one(spark, "theorem a : True := by sorry", T.exact_key)  # another preamble
    said = "<think>hm</think>\n```lean4\n import Mathlib \n\n-- EVOLVE-BLOCK-START\n@[simp]\nnoncomputable lemma f(x) :\n  x\ntheorem g : y\n```"
    assert one(spark, said, T.exact_text) == "import Mathlib\n@[simp]\nnoncomputable theorem __NAME__(x) : x"
    assert [one(spark, t, T.exact_text) for t in (None, "", "no declaration", "```\ndef x := 1\n```")] == ["", "", "", "def __NAME__ := 1"]
    assert one(spark, "theorem a : p := by simp", T.force_by_sorry) == "theorem a : p := by sorry"
    assert one(spark, None, T.signature) is None


def test_attempt_ids(spark):
    assert tuple(one(spark, "p1__ours__k03_g12", T.attempt_parts)) == ("p1", "ours", 3, 12)
    assert tuple(one(spark, "p1__ours__rr64__s02_g0", T.attempt_parts)) == ("p1", "ours", None, 0)
    assert tuple(one(spark, "p1_g4", T.attempt_parts)) == ("p1", None, None, 4)


def test_comments_and_complexity(spark):
    assert one(spark, "a -- b\n/- x\ny -/c", T.without_comments) == "a \nc"
    assert one(spark, "-- b\na -- c", lambda c: T.without_comments(c, "line_start")) == "a -- c"
    assert tuple(one(spark, "-- n\nif (a (b)) x\n", T.complexity)) == (2, 1, 1, 2)


def test_mcnemar_and_scores(spark):
    counts = [(5, 1), (0, 0), (3, 3), (1, 0), (0, 40), (9000, 9100), (40000, 41000)]
    rows = compare.mcnemar(spark.createDataFrame(counts, "wins long, losses long")).collect()
    for r in rows:
        n, k = r.wins + r.losses, min(r.wins, r.losses)
        tail = sum(math.comb(n, i) for i in range(k + 1)) if n < 100 else None
        want = min(1.0, 2 * tail / 2**n) if n < 100 else math.erfc((abs(r.wins - r.losses) - 1) / math.sqrt(2 * n))
        assert r.p_value == pytest.approx(want, rel=1e-9 if n < 100 else 1e-3)
    rows = spark.createDataFrame([(0, 1.0, 1, 1), (1, 1.0, 0, 0), (1, 0.0, 1, 0), (1, 1.0, 1, 0), (1, 0.0, 0, 1), (1, 1.0, 1, 1)], "c int, y double, s int, b int")
    got = [r[0] for r in rows.select(metrics.gated_score(F.col("c"), F.col("y"), F.col("s"), F.col("b"))).collect()]
    assert got == [0, 150, 200, 250, 300, 450]
    lp = spark.createDataFrame([(-3.5, 1), (None, 1), (-1.0, 0)], "l double, n int").select(metrics.cycle_score(F.col("l"), F.col("n"))).collect()
    assert lp[0][0] == pytest.approx(math.exp(-1)) and lp[1][0] == lp[2][0] == pytest.approx(math.exp(-100 / 3.5))


def test_ok_flag(spark):
    values = ['{"a": 1}', '{"a": 1.7}', '{"a": true}', '{"a": "x"}', '{"a": 0}', "broken", None, "{}"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, m string").select("k", metrics.ok_flag(F.col("m"), "a").alias("ok"))
    assert [r.ok for r in sorted(rows.collect())] == [True, True, True, False, False, False, False, False]


def test_concentration(spark):
    rows = spark.createDataFrame([("a", 1)] * 4 + [("b", 0)] * 3 + [("b", 4)], "k string, v int")
    gini = dict(metrics.gini(rows, ["k"], "v").collect())
    assert gini["a"] == pytest.approx(0, abs=1e-9) and gini["b"] == pytest.approx(0.75)
    assert dict(metrics.top_share(rows, ["k"], "v").collect()) == {"a": 0.25, "b": 1.0}
    assert dict((r.first, r.last) for r in metrics.compress_ranges(spark.createDataFrame([(0, x) for x in (0, 1, 2, 5, 7, 8, 8)], "k int, i int"), ["k"], "i").collect()) == {0: 2, 5: 5, 7: 8}


def test_budgets(spark):
    rows = spark.createDataFrame([(1, k) for k in range(5)], "problem_id int, id int")
    assert [r.n for r in sorted(select.round_robin(rows, 16, ["id"]).collect())] == [4, 3, 3, 3, 3]
    assert [r.n for r in sorted(select.round_robin(rows, 3, ["id"]).collect())] == [1, 1, 1]
    with pytest.raises(ValueError):
        select.budget_sweep(rows.withColumn("rank", F.col("id") + 1), [3], 16)


def test_stagnation_and_pareto(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 5, 6, 6, 6])], "p int, t int, v int")
    got = select.stagnation(rows, ["p"], ["t"], ["v"], 2).orderBy("t").collect()
    assert [r.streak for r in got] == [0, 1, 0, 1, 2] and [r.stagnated for r in got] == [0, 0, 0, 0, 1]
    points = [(1, 1, 3), (2, 2, 2), (3, 3, 1), (4, 1, 1), (5, 2, 2)]
    front = select.pareto_front(spark.createDataFrame([(0, *p) for p in points], "k int, id int, x int, y int"), ["k"], "x", "y")
    assert sorted(r.id for r in front.collect()) == [1, 2, 3, 5]
    for more_x, more_y, want in ((False, True, [1]), (True, False, [3]), (False, False, [4])):
        front = select.pareto_front(spark.createDataFrame([(0, *p) for p in [*points, (9, None, 9)]], "k int, id int, x int, y int"), ["k"], "x", "y", more_x, more_y)
        assert sorted(r.id for r in front.collect()) == want


def test_lineage(spark):
    rows = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)] + [(50, 50), (51, 99)], "id int, parent_id int")
    got = {r.id: (r.root, r.depth) for r in lineage.depths(rows).collect()}
    assert got == {k: (0, k) for k in range(20)} | {50: (50, 0), 51: (51, 0)}


def test_long_chains_and_cycles(spark):
    edges = [(k, k - 1 if k else None) for k in range(1000)] + [(2000, 2002), (2001, 2000), (2002, 2001), (2003, 2000), (3000, 0), (3001, 3000)]
    rows = spark.createDataFrame(edges, "id int, parent_id int")
    got = {r.id: (r.root, r.depth) for r in lineage.depths(rows).collect()}
    assert got == {k: (0, k) for k in range(1000)} | {3000: (0, 1), 3001: (0, 2)}
    assert {r.depth: r.rows for r in lineage.depth_counts(rows).collect()} == {k: 1 + (k in (1, 2)) for k in range(1000)}
    best = spark.createDataFrame([(1, 999), (2, 3001), (3, 2003), (4, 777777)], "problem_id int, id int")
    path = {}
    for r in lineage.path_to_best(rows, best).collect():
        path.setdefault(r.problem_id, {})[r.steps_back] = r.id
    assert path == {1: {k: 999 - k for k in range(1000)}, 2: {0: 3001, 1: 3000, 2: 0}, 3: {0: 2003, 1: 2000, 2: 2002, 3: 2001}, 4: {0: 777777}}


def test_statements(spark):
    code = "-- note\nimport Mathlib\ndef helper := 1\n\n/- x -/ lemma  my_lemma (n : Nat) : True  := by\n  sorry -- y\n"
    assert one(spark, code, T.canonical_statement) == "lemma  X (n : Nat) : True  := by\n  sorry"
    assert [one(spark, x, T.statement_of) for x in ("None", " n/a ", "", None, "def a := 1")] == ["", "", "", "", "def a := 1"]
    assert tuple(one(spark, "theorem t1 : p", lambda c: T.renamed(c, "X"))) == ("theorem X : p", "t1")
    assert one(spark, "theorem t1 (a : p) : q", T.unnamed) == "(a : p) : q"
    check = lambda x: tuple(one(spark, x, lambda c: T.precheck(c, F.lit("import M\n\ntheorem a : p := by sorry"), ["axiom"])))
    assert check("-- only") == (False, "empty") and check("axiom b") == (False, "forbidden: axiom")
    assert check("theorem a : q := by simp") == (False, "missing chunks: 1") and check("x\ntheorem a : p := by simp") == (True, "")


def test_plans_for_what_is_missing(spark):
    present = spark.createDataFrame([(1, 0, 4), (1, 2, 4)], "k int, i int, until int")
    expected = spark.createDataFrame([(1, 4), (2, 3), (3, 0)], "k int, until int")
    assert sorted(map(tuple, metrics.missing_ranges(present, ["k"], "i", "until", expected).collect())) == [(1, 1, 1), (1, 3, 3), (2, 0, 2)]
    movers = spark.createDataFrame([(k, 1, k % 3, 1, 1.0 * k, 0) for k in range(90)], "id int, problem_id int, island_idx int, compile_ok int, combined_score double, parent_id int")
    plan = select.migration_plan(movers).collect()
    assert len(plan) == 9 and all(r.to_island in {0, 1, 2} - {r.island_idx} for r in plan)
    assert len({(r.island_idx, r.to_island) for r in plan}) > 3
    assert select.migration_plan(movers.where("island_idx = 0")).collect() == []


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_archive_replay_equals_stream(spark, tmp_path):
    rows = [(k % 3, k, k, f"key{k % 7}", float(k * 7 % 11), k % 5 != 0) for k in range(60)]
    schema = "run_id long, id long, seq long, key string, score double, correct boolean"
    df = spark.createDataFrame(rows, schema).withColumn("correct", F.col("correct").cast("int"))
    want = {tuple(r) for r in archive.batch_archive(df, 4).collect()}
    assert len(want) == 12
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    query = (
        archive.stream_archive(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4)
        .writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert {tuple(r) for r in out} == want


def test_archive_of_long_and_unnamed_runs(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, None]), k, draw.choice([None, *[draw.randrange(500)] * 9]), f"key{draw.randrange(60)}", draw.choice([None, *[draw.randrange(9) / 2] * 9]), draw.randrange(4) > 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "run_id long, id long, seq long, key string, score double, correct boolean").withColumn("correct", F.col("correct").cast("int"))
    kept: dict = {}
    for run, ident, seq, key, score, ok in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
        if not ok or score is None:
            continue
        own = kept.setdefault(run, [])
        if key in [k[3] for k in own]:
            continue
        if len(own) == 5:
            worst = min(own, key=lambda k: (k[0], k[1] is None, k[1] or 0))
            if score < worst[0]:
                continue
            own.remove(worst)
        own.append((score, seq, ident, key))
    want = {(run, k[2], k[0], k[1]) for run, own in kept.items() for k in own}
    assert {tuple(r) for r in archive.batch_archive(df.repartition(5), 5).collect()} == want and len(want) == 15
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:  # runs go on over many batches
        assert {tuple(r) for r in archive.batch_archive(df, 5).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert archive.batch_archive(df.where("false"), 5).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_novelty_compares_every_row(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()
    first = {g: min(r.vec_id for r in e if r.label == g) for g in {r.label for r in e} - {None}}
    got = {r.query_id: r.similarity for r in catalog.QUERIES["novelty"](spark, SF).collect()}
    assert got.keys() == {r.vec_id for r in e}
    assert {k for k, s in got.items() if s is None} == {r.vec_id for r in e if r.label is None or r.vec_id == first[r.label]}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple(round(float(x), 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(key, df.select(columns).collect()))) == sorted(map(repr, map(key, found.fetchall())))


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0

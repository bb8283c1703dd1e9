"""Candidate texts, answers, attempts, populations, readers and result streams on small fixtures."""

import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaflow.functions import answers as A
from lemmaflow.functions import text as T
from lemmaflow.operators import attempts as P
from lemmaflow.operators import bandits as B
from lemmaflow.operators import compare, metrics, vectors
from lemmaflow.operators import population as G
from lemmaflow.sources import arrays
from lemmaflow.sources import databases as D
from lemmaflow.sources import readers as R
from lemmaflow.streaming import results


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


def many(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "code,levels",
    [
        ("theorem my_fixture_1 : True := by sorry", (True, True, True)),
        ("theorem r (n : Nat) : n = n := by sorry", (False, False, True)),
        ("theorem r (n : Nat) : n + 0 = n := by sorry", (False, False, False)),
        ("import Mathlib\n-- note\nlemma q (h : p) : ∀ x, True := by simp", (False, True, True)),
        ("theorem q : False → p := by simp", (False, True, True)),
        ("", (False, False, False)),
        (None, (False, False, False)),
    ],
)
def test_trivial_statements(spark, code, levels):
    rows = spark.createDataFrame([(code,)], "x string").select(*[T.is_trivial(F.col("x"), k).alias(f"l{k}") for k in (1, 2, 3)])
    assert tuple(rows.first()) == levels


def test_declaration_type(spark):
    assert one(spark, "theorem s : let x := 1; x = 1 := by rfl", T.declaration_type) == "let x"
    assert one(spark, "theorem s (a : b := c) : (let x := 1; x\n = 1) := by rfl", T.declaration_type) == "(let x := 1; x = 1)"
    assert one(spark, "theorem s", T.declaration_type) is None


def test_headers_and_blocks(spark):
    assert one(spark, "import Mathlib\nabbrev a_solution : Nat := sorry\n", T.opaque_header) == "import Mathlib\nopaque a_solution : Nat"
    assert tuple(one(spark, "import M\n\ntheorem a : b := by sorry\n", T.header_and_theorem)) == ("import M", "theorem a : b := by sorry")
    assert tuple(one(spark, "import M", T.header_and_theorem)) == ("import M", "")
    assert one(spark, "import M\n@[simp]\ntheorem a : b", T.preamble) == "import M"
    assert one(spark, "0000_hack_1", T.theorem_key) == "hack_1"
    assert many(spark, [("h ", " s"), ("", "s"), (None, "s")], "h string, s string", T.compose_file(F.col("h"), F.col("s"))) == [("h\n\ns",), ("s",), ("s",)]
    code = "open X\ntheorem a : p := by sorry\n\n  lemma b : q := by simp\n"
    assert one(spark, code, T.theorem_blocks) == ["theorem a : p := by sorry", "lemma b : q := by simp"]
    assert one(spark, code, T.has_closed_block) is True and one(spark, "open X", T.has_closed_block) is False
    assert one(spark, code, T.theorem_name) == "a"
    assert [one(spark, code, lambda c, n=n: T.target_is_open(c, F.lit(n))) for n in ("a", "b", "z")] == [True, False, True]


def test_answer_checks(spark):
    statement = "import Mathlib\n\nabbrev a_solution : Nat := sorry\n\ntheorem t : a_solution = 1 := by sorry"
    assert one(spark, statement, T.solution_tags) == ["a_solution"]
    got = many(spark, [(["3"],), (["3", "4"],), ([" "],), (None,)], "a array<string>", T.with_answer_checks(F.lit("code"), F.lit(statement), F.col("a")))
    assert [tuple(r[0]) for r in got] == [
        (True, "", "code\n\nexample: a_solution = 3 := by\n  try rfl\n  try norm_num"),
        (False, "arity mismatch: tags=1 answers=2", "code"), (False, "empty answer", "code"), (True, "", "code"),
    ]


def test_messages(spark):
    texts = ["Type mismatch at", "expected ',' got ';'", "", None, "zzz", "x not in scope", "failed to synthesize", "deterministic timeout", "bad import"]
    got = [r[0] for r in many(spark, [(t,) for t in texts], "x string", metrics.failure_class(F.col("x")))]
    assert got == ["type_mismatch", "syntax_error", "unknown", "unknown", "other", "unbound_variable", "typeclass_error", "timeout", "import_error"]
    assert one(spark, "abcdef", lambda c: T.truncated(c, 3)) == "abc... [truncated]"
    assert one(spark, "4. x\n5. Accuracy Confirmation: all\ngood ", T.accuracy_section) == "all\ngood"
    assert one(spark, "import Mathlib\n\nimport Aesop\n", T.import_prefix) == "" and one(spark, "import Aesop", T.import_prefix) == "missing_required_import_lines"


def test_proofs_and_fences(spark):
    merge = T.merged_proof(F.col("s"), F.col("p"))
    rows = [("theorem t : p := by sorry", "theorem x : q := by\n    simp\n      ring"), ("theorem t : p := by sorry", "by simp"), ("theorem t", "x"), ("theorem t : p := by", "")]
    assert [r[0] for r in many(spark, rows, "s string, p string", merge)] == ["theorem t : p := by\nsimp\n  ring\n", "theorem t : p := by\nsimp\n", "", ""]
    assert one(spark, "a\n```lean4\nx\n```\n```lean4\ntheorem y\n```", T.fenced_proof) == "theorem y"
    assert one(spark, "```lean4\ntheorem y", T.fenced_proof) == "theorem y" and one(spark, "hm\ntheorem y", T.fenced_proof) == "theorem y"
    assert one(spark, "<think>z</think>```lean\ntheorem y\n```", T.normal_code) == "theorem y"
    got = one(spark, "theorem a : 1 = 2 := by sorry\nopen Nat\ntheorem b : 1 = 1 := by sorry\nbye", A.best_block)
    assert got.source == "no_fence" and got.code == "import Mathlib\nimport Aesop\nopen Nat\n\ntheorem b : 1 = 1 := by sorry"
    assert tuple(one(spark, "nothing", A.best_block)) == (None, "")


def test_verdicts(spark):
    plain = '{"reasons": "r {", "is_assistant_correct": "Correct"}'
    nested = '{"a": {"b": 1}, "is_assistant_correct": "Incorrect"}'
    deep = '{"a": {"b": {"c": [{"d": "}"}]}}, "is_assistant_correct": "Incorrect"}'
    long = "word " * 150
    cases = [
        (plain, ("Correct", "r {", "json")),
        (f"so {plain} ok", ("Correct", "r {", "extracted_json")),
        ('{"is_assistant_correct": "Incor', (None, '[ParseError] Could not extract verdict\n{"is_assistant_correct": "Incor', "failed")),
        ('"is_assistant_correct": "Incorrect', ("Incorrect", '"is_assistant_correct": "Incorrect', "salvaged_key")),
        ("It is not correct.\nIncorrect", ("Incorrect", "It is not correct.\nIncorrect", "salvaged_word")),
        (None, (None, "[ParseError] Empty model output", "failed")),
        ("maybe", (None, "[ParseError] Could not extract verdict\nmaybe", "failed")),
        (f"```json\n{plain}\n```", ("Correct", "r {", "json")),
        (f"{plain} then {nested}", ("Incorrect", f"{plain} then {nested}", "extracted_json")),
        (f"{nested} {plain} {nested}", ("Incorrect", f"{nested} {plain} {nested}", "extracted_json")),
        ("correct " * 100 + "\nincorrect\n", ("Incorrect", ("correct " * 100 + "\nincorrect").strip(), "salvaged_word")),
        (deep, ("Incorrect", deep, "json")),
        (f"I say {deep}.", ("Incorrect", f"I say {deep}.", "extracted_json")),
        (f'{long} the "Incorrect" one, {long}', ("Incorrect", f'{long} the "Incorrect" one, {long}'.strip(), "salvaged_word")),
        (f"{long} is correct, {long}", (None, "[ParseError] Could not extract verdict\n" + f"{long} is correct, {long}".strip(), "failed")),
        ('{"is_assistant_correct": "Correct", }', ("Correct", '{"is_assistant_correct": "Correct", }', "salvaged_key")),  # no JSON
        ("is_assistant_correct" + " " * 200 + ": incorrect" + " x" * 300, ("Incorrect", "is_assistant_correct" + " " * 200 + ": incorrect" + " x" * 300, "salvaged_key")),
        ("is_assistant_correct" + " " * 256 + ": incorrect" + " x" * 300, (None, "[ParseError] Could not extract verdict\nis_assistant_correct" + " " * 256 + ": incorrect" + " x" * 300, "failed")),
        ('[{"is_assistant_correct": "correct or incorrect"}]', ("Incorrect", '[{"is_assistant_correct": "correct or incorrect"}]', "extracted_json")),
        ('} { "open', (None, '[ParseError] Could not extract verdict\n} { "open', "failed")),
        ("{" * 5000, (None, "[ParseError] Could not extract verdict\n" + "{" * 5000, "failed")),
        ('{"a":' * 3000 + "1" + "}" * 3000, (None, "[ParseError] Could not extract verdict\n" + '{"a":' * 3000 + "1" + "}" * 3000, "failed")),
    ]
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x string")
    got = {r.k: tuple(r.v) for r in rows.select("k", A.verdict(F.col("x")).alias("v")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == want, k
    stopped = rows.where("k = 6").select(A.verdict(F.col("x"), finish=F.lit("length")).alias("v")).first().v
    assert stopped.reasons == "[ParseError] Could not extract verdict (finish_reason=length)\nmaybe"


def test_functions_in_sql(spark):
    from lemmaflow.functions import sql

    sql.register(spark)
    said = spark.sql("""SELECT judge_verdict('{"is_assistant_correct": "Correct"}', null) AS v, match_ratio('a b', 'a b') AS r, folded_text(' a\n b ') AS f, code_tokens('theorem x : 1') AS t""").first()
    assert (said.v.verdict, said.v.method, said.r, said.f, said.t) == ("Correct", "json", 1.0, "a b", ["theorem", "_NAME_", ":", "1"])
    assert [r.g for r in spark.sql("SELECT * FROM attempt_slots(3)").collect()] == [0, 1, 2]
    assert spark.sql("SELECT n, g FROM VALUES (0), (2), (NULL), (-1) AS t(n), LATERAL attempt_slots(n)").count() == 2
    answer = "x\n```lean4\na\nb\n```\n```\nc```"
    blocks = spark.createDataFrame([(answer,), (None,)], "a string")
    blocks.createOrReplaceTempView("_answers")
    assert [tuple(r) for r in spark.sql("SELECT b.* FROM _answers, LATERAL fenced_blocks(a) b ORDER BY number").collect()] == [(0, "lean4", "a\nb\n"), (1, "", "c")]
    assert sorted(map(tuple, spark.sql("SELECT * FROM token_changes('theorem a : p p', 'lemma b : p q')").collect())) == [("lemma", 0, 1), ("p", 2, 1), ("q", 0, 1), ("theorem", 1, 0)]
    code = lambda body: f"h\n# EVOLVE-BLOCK-START\n{body}\n# EVOLVE-BLOCK-END"
    pairs = spark.createDataFrame([(1, code("theorem a : x y"), code("theorem b : x z z")), (2, "x", code("y")), (3, None, None), (4, code(""), code(""))], "k int, a string, b string")
    pairs.createOrReplaceTempView("_code_pairs")
    got = {r.k: tuple(r.c) for r in spark.sql("SELECT k, marked_change(a, b) AS c FROM _code_pairs").collect()}
    assert got == {1: (True, 5, 6, 2, 1, pytest.approx(4 / 7)), 2: (False, *[None] * 5), 3: (False, *[None] * 5), 4: (True, 0, 0, 0, 0, 1.0)}
    whole = {r.k: r for r in A.change_stats(pairs, ["k"], "a", "b", marked=True).collect()}
    assert tuple(whole[1])[1:9] == (True, None, True, True, 20, 22, 5, 6) and tuple(whole[1])[10:12] == (2, 1)
    assert tuple(whole[2])[1:6] == (False, "missing_evolve_block", False, True, None) and whole[4].ok and whole[4].token_jaccard == 1.0


def test_marked_blocks(spark):
    mark = "EVOLVE-BLOCK"
    cases = {
        f"a\n{mark}-START\n b \n{mark}-END\nc": "b",
        f"// {mark}-START\nb\n{mark}-START x\nc": "b\nc",
        f"{mark}-END\n{mark}-START\nb": None,
        f"{mark}-START": "",
        f"x {mark}-START\nb": None,
        f"--{mark}-START now\nb\n-- {mark}-END\nc\n{mark}-END": "b",
        "": None,
    }
    assert [r[0] for r in many(spark, [(c,) for c in cases], "s string", A.marked_block(F.col("s")))] == list(cases.values())


def test_text_pairs(spark):
    pairs = spark.createDataFrame([(1, "theorem a : x y", "theorem b : x z z"), (2, None, None), (3, "", "w")], "k int, a string, b string")
    stats = A.change_stats(pairs, ["k"], "a", "b").select("k", "parent_tokens", "child_tokens", "token_jaccard", "added", "removed", "length_ratio", "sequence_ratio")
    got = {r.k: tuple(r)[1:] for r in stats.collect()}
    assert got[1][:5] == (5, 6, pytest.approx(4 / 7), 2, 1) and got[1][5] == 1.2
    assert got[2] == (0, 0, 1.0, 0, 0, 0.0, 1.0) and got[3] == (0, 1, 0.0, 1, 0, 1.0, 0.0)
    rows = [("theorem a : p", "theorem  b :\n p"), ("", ""), ("x", None)]
    assert [r[0] for r in many(spark, rows, "a string, b string", A.similarity_ratio(F.col("a"), F.col("b")))] == [1.0, 1.0, 0.0]


def test_diff_counts(spark):
    diff = "--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n-a\n-b\n+c\n x\n@@ -9 +9,2 @@\n+d\n--- a/g\n+++ b/g\n@@ -1 +0,0 @@\n--- gone\n"
    got = P.diff_counts(spark.createDataFrame([(1, diff)], "diff_id int, diff string")).collect()
    assert sorted((r.file, r.added, r.deleted, r.modified) for r in got) == [("f", 1, 1, 1), ("g", 0, 1, 0)]


def test_plans(spark):
    wanted = spark.createDataFrame([("a", 3), ("b", 0)], "origin string, n int")
    records = spark.createDataFrame([("a", 0, "x", None, None, None, 5), ("a", 1, None, None, "HTTP 503", None, 5)], "origin string, g int, model_output string, full_code string, error string, infra_retry int, max_tokens int")
    plan = lambda *a: sorted(r.g for r in P.resume_targets(wanted, records, *a).collect())
    assert plan([]) == [2] and plan(["503"]) == [1, 2] and plan(["503"], 1) == [2] and plan([], 0, 9) == [1, 2]
    tasks = spark.createDataFrame([("t", 5, True), ("u", 2, False)], "task string, n int, finished boolean")
    gaps = P.missing_samples(tasks, spark.createDataFrame([("t", 1), ("t", 1), ("t", 4)], "task string, sample int")).collect()
    assert [tuple(r) for r in gaps] == [("t", 3, 2, 0, 3)]


def test_inspirations_against_brute_force(spark):
    n, share, rows = 4, 0.5, [(p, i % 2, p * 100 + i, float(i * 7 % 13), int(i % 5 > 0)) for p in range(3) for i in range(30)]
    archive = spark.createDataFrame(rows, "problem_id int, island_idx int, id int, combined_score double, compile_ok int")
    u = {r.id: r.u for r in archive.select("id", G.hash_uniform(0, "id").alias("u")).collect()}
    parents = archive.where("id % 10 = 1")
    got = {}
    for r in G.inspirations(parents, archive, n, share).collect():
        got.setdefault(r.parent, []).append((r.place, r.id))
    for q in parents.collect():
        ok = [r for r in rows if r[0] == q.problem_id and r[4]]
        best = min(ok, key=lambda r: (-r[3], r[2]))[2]
        want = [best] if best != q.id else []
        home = sorted((r for r in ok if r[1] == q.island_idx and r[2] not in (q.id, best)), key=lambda r: (-r[3], r[2]))
        want += [r[2] for r in home[: int(n * share)]]
        want += sorted((r[2] for r in home if r[2] not in want), key=u.get)
        assert [i for _, i in sorted(got[q.id])] == want[:n]


def test_draws(spark):
    rows = spark.createDataFrame([(1, i, 0.7 if i == 0 else 0.1) for i in range(4)], "k int, id int, p double")
    hits = sum(G.draw(rows, ["k"], "p", 1, seed).first().id == 0 for seed in range(12))
    assert 4 <= hits <= 12
    assert sorted(r.id for r in G.draw(rows, ["k"], "p", 4, 1).collect()) == [0, 1, 2, 3]
    first = rows.where("id = 0")
    assert G.second_parents(rows.withColumn("r", (F.col("id") == 2).cast("int")), first, ["k"], "r", 1).first().second_id == 2


def test_cycle_softmax_without_values(spark):
    rows = spark.createDataFrame([(1, 1, None, 0), (1, 2, None, 3), (2, 3, -1.0, 0), (2, 4, None, 0)], "k int, id int, lp double, c int")
    assert {r.id: r.probability for r in G.cycle_softmax(rows, ["k"], "lp", "c").collect()} == {1: 0.5, 2: 0.5, 3: 1.0, 4: 0.0}


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_bandit_stream_equals_fold(spark, tmp_path):
    log = spark.createDataFrame([(k % 2, k, f"a{k % 3}", float(k % 5)) for k in range(40)], "bandit long, seq long, arm string, gain double")
    near = lambda rows: sorted((r.bandit, r.arm, round(r.pulls, 9), round(r.total, 9)) for r in rows)
    out = []
    q = G.bandit_stream(_stream(spark, log, str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert near(out) == near(G.bandit_fold(log).collect())


def _bandit_log(n=60):
    gains = [None, 0.0, 1.5, 400.0, 0.2, 900.0, 0.2, -3.0]
    return [(k % 2, k, f"a{k % 3}", gains[k % 8] if k % 3 and k < 50 else 0.0) for k in range(n)] + [(7, 0, "x", None), (7, 1, "x", 0.0), (8, 0, "x", 1000.0), (9, 0, "x", 400.0)] + [(10, k, "y" if k else "x", 0.01) for k in range(400)]


def _plain_states(log, decay):
    """One bandit's log step by step: pulls and log total of each arm, and the range."""
    arms, top = {}, B.NONE
    for arm, z in log:
        own = arms.setdefault(arm, [0.0, B.NONE])
        g = math.log(math.expm1(z)) if z and 0 < z < 50 else z if z and z > 0 else B.NONE
        own[0], own[1], top = own[0] + 1.0, float(np.logaddexp(own[1], g)), max(top, g)
        fewer = lambda x: x + math.log(decay) - float(np.logaddexp(0.0, x + math.log(1 - decay))) if decay < 1 else x
        for x in arms.values():
            x[0], x[1] = x[0] * decay, fewer(x[1])
        if top > B.NONE:
            top = max(fewer(top), *(x[1] - math.log(max(x[0], 1e-7)) for x in arms.values()))
    return {a: (p, t) for a, (p, t) in arms.items()}, top


def _plain_bandits(log, decay):
    out = {}
    for bandit in {r[0] for r in log}:
        arms, top = _plain_states([(arm, z) for b, _, arm, z in log if b == bandit], decay)
        out |= {(bandit, a): (pytest.approx(p), pytest.approx(t, abs=1e-9), pytest.approx(top, abs=1e-9)) for a, (p, t) in arms.items()}
    return out


@pytest.mark.parametrize("decay,chunk", [(0.95, 4), (0.95, 65536), (1.0, 7)])
def test_bandit_log_totals(spark, decay, chunk):
    """Against the step by step fold, over several chunks, with nulls, no gain, gains beyond the range of exp and a long idle arm."""
    df = spark.createDataFrame(_bandit_log(), "bandit long, seq long, arm string, gain double")
    got = {(r.bandit, r.arm): (r.pulls, r.log_total, r.log_range) for r in B.bandit_log_totals(df, decay, chunk).collect()}
    assert got == _plain_bandits(_bandit_log(), decay)
    assert B.bandit_log_totals(df.limit(0)).collect() == []
    if decay == 1.0:  # nothing shrinks: totals are the gains
        assert (got[8, "x"][1], got[9, "x"][1]) == (1000.0, 400.0)


def test_gains_of_any_size_differ_at_once():
    f = 0.95  # a total shrinks to about f / (1 - f) whatever the gain, but not before the reward is over
    assert B.log_add(B.NONE, B.log_gain(400.0)) == 400.0 and B.log_add(B.NONE, B.log_gain(1000.0)) == 1000.0
    for z in (400.0, 1000.0):
        assert _plain_states([("x", z)], f)[0]["x"][1] == pytest.approx(math.log(f / (1 - f)))
    assert _plain_states([("x", 1.0)], f)[0]["x"][1] == pytest.approx(math.log(f * math.expm1(1) / (1 + (1 - f) * math.expm1(1))))


def test_bandit_log_stream_equals_batch(spark, tmp_path):
    log = [r for r in _bandit_log() if r[0] < 10]
    df = spark.createDataFrame(log, "bandit long, seq long, arm string, gain double")
    for k, part in enumerate((df.where("seq < 20"), df.where("seq >= 20"))):  # one file a batch
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}
    q = B.bandit_log_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.update({(r.bandit, r.arm): (r.pulls, r.log_total, r.log_range) for r in b.collect()})).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert out == _plain_bandits(log, 0.95)


def test_arm_scores(spark):
    state = spark.createDataFrame([(1, "a", 2.0, 3.0, 4.0, 3), (1, "b", 1.0, -math.inf, 4.0, 1), (2, "a", 1.0, -math.inf, -math.inf, 1)], "bandit long, arm string, pulls double, log_total double, log_range double, n long")
    got = {(r.bandit, r.arm): (r.mean, r.score) for r in B.arm_scores(state).collect()}
    assert got[1, "a"] == (pytest.approx(math.exp(-1) / 2), pytest.approx(math.exp(-1) / 2 + math.sqrt(2 * math.log(4) / 3)))
    assert got[1, "b"] == (0.0, pytest.approx(math.sqrt(2 * math.log(4)))) and got[2, "a"][0] == 0.0


def test_text_archive_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, k, f"t{k % 9}", float(k % 9 * 5 % 7)) for k in range(50)], "run_id long, seq long, text string, reward double")
    out = []
    q = results.text_archive(_stream(spark, rows, str(tmp_path / "in")), 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in out} == {tuple(r) for r in results.batch_text_archive(rows, 3).select("run_id", "text", "reward", "seq").collect()}


def test_upserts(spark, tmp_path):
    merge = results.upsert_newest(str(tmp_path / "out"), "name", "at", 4)
    schema = "name string, at int, ok int"
    merge(spark.createDataFrame([(f"n{k}", 1, 0) for k in range(9)], schema), 0)
    new = spark.createDataFrame([("n3", 2, 1), ("n4", 0, 1), ("z", 5, 1)], schema)
    merge(new, 1)
    merge(new, 1)  # a batch that is run twice
    got = {r.name: (r.at, r.ok) for r in results.latest(spark, str(tmp_path / "out"), new.withColumn("bucket", F.lit(0)).schema).collect()}
    assert got == {f"n{k}": (1, 0) for k in range(9)} | {"n3": (2, 1), "z": (5, 1)}


def test_watch(spark):
    seen = []
    tasks = spark.createDataFrame([("t", 2, True), ("u", 2, True)], "task string, n int, finished boolean")
    check = results.watch_missing(tasks, lambda rows: seen.extend(r.task for r in rows.collect()), lambda: spark.createDataFrame([("t", 0)], "task string, sample int"))
    check(spark.createDataFrame([("t",)], "task string"), 0)
    assert seen == ["t"]


def test_readers(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "r.json").write_text(json.dumps([{"name": "a", "code": "x", "compilation_result": {"pass": True, "errors": []}}, {"name": " ", "code": "y"}], indent=1))
    assert [(r.name, r.pass_ok, r.complete_ok) for r in R.compile_results(spark, str(tmp_path / "c")).collect()] == [("a", 1, 0)]
    for run, body in (("r1", {"total_budget_calls": 5}), ("r2", {"no_llm": 1})):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "termination_log.json").write_text(json.dumps(body))
    logs = R.termination_logs(spark, str(tmp_path / "runs"))
    assert {r.run_id: r.total_budget_calls for r in logs.collect()} == {"r1": 5, "r2": None}
    expected = spark.createDataFrame([("r1",), ("r3",)], "run_id string")
    assert [tuple(r) for r in R.missing_files(expected, expected.where("run_id = 'r1'"), logs).collect()] == [("r3", True, True)]
    for k, text in enumerate(["{}", ""]):
        (tmp_path / "s" / "task" / f"sample_{k}").mkdir(parents=True)
        (tmp_path / "s" / "task" / f"sample_{k}" / "metrics.json").write_text(text)
    assert [tuple(r) for r in R.present_samples(spark, str(tmp_path / "s")).collect()] == [("task", 0)]
    (tmp_path / "j" / "job1").mkdir(parents=True)
    (tmp_path / "j" / "job1" / "correct.json").write_text('{"correct": true}')
    got = R.job_results(spark, str(tmp_path / "j")).first()
    assert (got.job, got.metrics, got.correct, got.error, got.stdout) == ("job1", "{}", True, None, "")
    rows = spark.createDataFrame([("a", [" ", "1"]), ("b", None)], "theorem_name string, answer array<string>")
    assert {r.theorem_name: r.answers for r in R.answers(rows).collect()} == {"a": ["1"], "b": None}
    assert R.labelled_union({"x": rows, "y": rows.drop("answer")}).where("run = 'y' and answer is null").count() == 2


def test_token_changes_join_and_shuffle_no_texts(spark):
    from lemmaflow.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "a b a", "b b"), (2, None, "x"), (3, "", None), (4, "é b", "é b"), (5, "a b a", "b b")], "k int, p string, c string").createOrReplaceTempView("_texts")
    changed = spark.sql("SELECT k, token, parent_n, child_n FROM _texts, LATERAL token_changes(p, c)")
    assert sorted(map(tuple, changed.collect())) == [(1, "a", 2, 0), (1, "b", 1, 2), (2, "x", 0, 1), (5, "a", 2, 0), (5, "b", 1, 2)]
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_run_databases_and_selection(spark, tmp_path):
    (tmp_path / "runs" / "r").mkdir(parents=True)
    db = sqlite3.connect(tmp_path / "runs" / "r" / D.FILE)
    db.execute("create table programs (id text, code text, generation int, combined_score real, public_metrics text, correct int)")
    db.executemany("insert into programs values (?, 'c', ?, 1.5, ?, 1)", [("a", 0, '{"compile_ok": 1}'), ("b", 1, "broken"), ("c", 2, None), ("d", "x", "{}"), ("e", 4, "[]"), ("f", 5, '{"compile_ok": 0}')])
    db.commit()
    db.close()
    for name, body in (("broken", b"no database"), ("none", b"")):
        (tmp_path / "runs" / name).mkdir()
        (tmp_path / "runs" / name / D.FILE).write_bytes(body)
    every = D.run_databases(spark, str(tmp_path / "runs"), rows=2)
    assert every.rdd.getNumPartitions() == 3  # ranges of two row ids
    got = sorted((r.run_id, r.seq, r.id, r.generation, r.correct, r.metric_compile_ok, r.parent_id) for r in R.typed_programs(every).collect())
    assert got == [("r", 1, "a", 0, True, 1.0, None), ("r", 4, "d", None, True, None, None), ("r", 6, "f", 5, True, 0.0, None)]
    assert [r.id for r in every.where("generation > 0 and id in ('a', 'f')").select("id").collect()] == ["f"]
    assert D.run_databases(spark, str(tmp_path / "nothing")).count() == 0
    rows = spark.createDataFrame([(f"run {k % 3}", k + 1, str(k), None if k % 5 == 0 else k, k / 2, "{}") for k in range(40)], "run_id string, seq long, id string, generation int, combined_score double, public_metrics string")
    D.write_databases(rows, str(tmp_path / "made"))
    D.write_databases(rows, f"file://{tmp_path}/made")  # a task that runs twice
    back = D.run_databases(spark, f"file:{tmp_path}/made", rows=7).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError):
        D.local_path("hdfs://x/y")


def test_run_databases_are_read_by_few_tasks(spark, tmp_path):
    """Row ids far apart and many small files: a task reads several ranges."""
    sparse = [("far", k * 500 + 1, str(k), k, True) for k in range(100)]
    small = [(f"r{k}", s, f"{k}.{s}", 2**53 + 1 if s == 1 else None, None) for k in range(90) for s in (3, 1, 2)]
    kind = "run_id string, seq long, id string, public_metrics string, metadata string, correct boolean"
    rows = spark.createDataFrame([(run, seq, id, "{}", str(n), flag) for run, seq, id, n, flag in sparse + small], kind)
    D.write_databases(rows, str(tmp_path))
    back = D.run_databases(spark, str(tmp_path), rows=2)
    assert 2 <= back.rdd.getNumPartitions() <= 32 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert sorted(r.id for r in back.where("seq > 40000 and correct").collect()) == sorted(id for run, seq, id, _, _ in sparse if seq > 40000)
    R.write_selection(spark.createDataFrame([(1, 1, "s"), (1, 2, "t")], "problem_id int, rank int, signature string"), str(tmp_path / "out"))
    assert [r.rank for r in spark.read.json(str(tmp_path / "out" / "index")).first().selected] == [1, 2]


def _small_blocks(spark, path, size=400):
    """Reads with blocks of so few bytes."""
    for key, value in (("maxPartitionBytes", size), ("openCostInBytes", 0)):
        spark.conf.set(f"spark.sql.files.{key}", value)


@pytest.mark.parametrize("indent,size", [(None, 300), (2, 300), (2, 128 << 20), (None, 60)])
def test_json_arrays_by_many_tasks(spark, tmp_path, indent, size):
    odd = ["}", "{", '"', "\\", '\\"}', "a\nb", "[{]", "é}😀", "", "\\\\"]
    rows = [{"name": f"p{k}", "code": odd[k % len(odd)] * (k % 4 + 1), "compilation_result": {"pass": k % 2 == 0, "infos": [{"data": odd[(k + 3) % len(odd)], "pos": {"line": k, "column": 1}}], "sorries": [{}] * (k % 3)}} for k in range(120)]
    files = {"a.json": rows, "b.json": [], "c.json": [1, "x{", rows[0], [rows[1]], None, rows[2]], "d.json": rows[5], "e.json": rows[:3]}
    (tmp_path / "in").mkdir()
    for name, body in files.items():
        text = json.dumps(body, indent=indent, ensure_ascii=False)
        (tmp_path / "in" / name).write_text(text[: text.rindex("}") - 3] if name == "e.json" else text)
    try:
        _small_blocks(spark, tmp_path, size)
        if size < 1000:
            assert arrays.pieces(spark, str(tmp_path / "in" / "a.json"), "}").rdd.getNumPartitions() > 10
        got = {}
        for r in arrays.json_array_elements(spark, str(tmp_path / "in")).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.element] = json.loads(r.text)
        results = {r.name: r for r in R.compile_results(spark, str(tmp_path / "in" / "a.json")).collect()}
    finally:
        _small_blocks(spark, tmp_path, 128 << 20)
    assert [got["a.json"][k] for k in range(120)] == rows and len(got["a.json"]) == 120
    assert "b.json" not in got and list(got["c.json"].values()).count(rows[0]) == 1 and got["d.json"] == {0: rows[5]} and got["e.json"] == {0: rows[0], 1: rows[1]}
    assert len(results) == 120 and results["p7"].infos[0].data == odd[0] and len(results["p8"].sorries) == 2 and (results["p8"].pass_ok, results["p8"].complete_ok) == (1, 0)


def test_problems_are_numbered_over_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('{"formal_stmt": "x"}\n\n{"problem_name": " "}\n{"problem_name": "own", "header": ""}\n')
    (tmp_path / "p" / "b.jsonl").write_text("\n".join(json.dumps({"informal_stmt": f"i{k}"}) for k in range(3)))
    try:
        _small_blocks(spark, tmp_path, 20)
        got = [(r["index"], r.problem_name, r.full_name, r.header) for r in R.problems(spark, str(tmp_path / "p")).orderBy("index").collect()]
        few = [r["index"] for r in R.problems(spark, str(tmp_path / "p"), first=3).collect()]
    finally:
        _small_blocks(spark, tmp_path, 128 << 20)
    names = ["problem_0000", "problem_0001", "own", "problem_0003", "problem_0004", "problem_0005"]
    assert got == [(k, n, n, "import Mathlib") for k, n in enumerate(names)] and sorted(few) == [0, 1]


def test_vectors(spark):
    rows = spark.createDataFrame([(k, 0, [float(k % 3), 1.0, float(k)]) for k in range(12)] + [(99, 0, [0.0, 0.0, 0.0])], "id long, island_idx int, embedding array<double>")
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, block=3).collect()}
    data = {r.id: r.embedding for r in rows.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
    assert pairs == {(a, b) for a in data for b in data if a < b and cos(data[a], data[b]) >= 0.9}
    assert all(len(r.pca) == 2 for r in vectors.principal_components(rows, 2).collect())
    assert {r.cluster for r in vectors.clusters(rows.limit(2), 4).collect()} == {None}


@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_of_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(6, 5))
    data = [(k, k % 3, (middles[k % 6] + 0.1 * rng.normal(size=5)).tolist()) for k in range(90)]
    data += [(100 + k, 0, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(4)]  # ties
    data += [(110, 0, None), (111, 0, []), (112, 1, [0.0] * 5), (113, 1, [1.0, None, 2.0, 3.0, 4.0]), (114, 2, [1.0, 2.0]), (115, 2, [2.0, 1.0]), (116, 0, [float("nan")] * 5), (-1, 1, [0.0] * 5), (117, None, [1.0] * 5)]
    rows = spark.createDataFrame(data, "id long, island_idx int, embedding array<double>")

    def cosine(a, b):
        usable = a and b and len(a) == len(b) and None not in a + b and all(map(math.isfinite, a + b)) and any(a) and any(b)
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9) if usable else 0.0

    own = lambda i, j: i is not None and i == j
    for group, together in (("island_idx", own), (None, lambda i, j: True)):
        want = set()
        for i, g, v in data:
            best = sorted((-cosine(v, w), j) for j, h, w in data if j != i and together(g, h))[:3]
            want |= {(i, j, -s, k + 1) for k, (s, j) in enumerate(best)}
        got = {(r.query_id, r.id, round(r.similarity, 9) + 0.0, r["rank"]) for r in vectors.most_similar(rows, rows, 3, group, block).collect()}
        assert got == {(i, j, s + 0.0, k) for i, j, s, k in want}
        some = rows.where("id % 10 = 0")
        every = {(r.query_id, r.id): round(r.similarity, 9) for r in vectors.similarities(some, rows, group, block).collect()}
        assert every == {(i, j): cosine(v, w) for i, g, v in data for j, h, w in data if i % 10 == 0 and together(g, h)}
    new = {r.query_id: (None if r.similarity is None else round(r.similarity, 9), r.novel) for r in vectors.novelty(rows.withColumn("generation", F.col("id") % 4), rows, 0.95, "generation", block=block).collect()}
    for i, g, v in data:
        seen = [cosine(v, w) for j, h, w in data if j < i and own(g, h)] if i % 4 else []
        assert new[i] == ((max(seen), int(max(seen) <= 0.95)) if seen else (None, 1))
    pairs = {(r.island_idx, r.a, r.b) for r in vectors.similar_pairs(rows, 0.97, block=block).collect()}
    assert pairs == {(g, i, j) for i, g, v in data for j, h, w in data if i < j and own(g, h) and cosine(v, w) >= 0.97}


def test_blocks_meet_without_copies_of_rows(spark):
    """No vector goes through a shuffle for the blocks that it meets; a task keeps the best of all blocks it meets."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(60, 4)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(data)], "id long, island_idx int, embedding array<float>")
    best = vectors.most_similar(rows, rows, 2, group=None, block=5)
    for df in (best, vectors.most_similar(rows, rows, 2, block=5), vectors.similar_pairs(rows, 0.9, block=5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "CoGroup" not in plan
    units = data / np.linalg.norm(data, axis=1)[:, None]
    close = units @ units.T - 9 * np.eye(60)
    assert sorted((r.query_id, r["rank"], r.id) for r in best.collect()) == [(q, n + 1, int(r)) for q in range(60) for n, r in enumerate(np.argsort(-close[q])[:2])]


def test_path_steps(spark):
    from lemmaflow.operators import lineage

    codes = {1: "a\nb\nc", 2: "a\nx\nb\nc", 3: "a\nx\nb", 4: None, 5: "-- b\n++ c", 6: "-- b"}
    parents = {1: None, 2: 1, 3: 2, 4: 2, 5: 99, 6: 5}
    programs = spark.createDataFrame([(k, parents[k], codes[k]) for k in codes], "id long, parent_id long, code string")
    best = spark.createDataFrame([("p", 3), ("q", 6), ("r", 4)], "problem_id string, id long")
    got = {(r.problem_id, r.step): (r.id, r.code, r.patch, r.added, r.removed) for r in lineage.path_steps(programs, best).collect()}
    assert got["p", 0] == (1, codes[1], None, None, None)
    assert got["p", 1] == (2, codes[2], "--- before\n+++ after\n@@ -1,3 +1,4 @@\n a\n+x\n b\n c", 1, 0)
    assert got["p", 2][3:] == (0, 1) and got["q", 1][3:] == (0, 1) and got["q", 0][0] == 5
    assert got["r", 2] == (4, None, None, None, None) and len(got) == 8


def test_any_statement_of_a_hot_problem(spark):
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(words, n))
    statements = [(int(g), f"theorem {say(rng.integers(1, 5))}\n\nhave {say(2)}" if k % 3 else say(rng.integers(1, 3))) for k, g in enumerate(rng.choice([0, 0, 0, 1, 2], 80))] + [(0, ""), (0, None), (1, "x := by sorry"), (None, "w1 w2 w3")]
    code = lambda g, t: f"-- {say(3)}\n{say(5)}\n{(t or '').replace(chr(10), chr(10) + say(1) + chr(10))}z {say(4)}"
    own = [statements[int(k)] for k in rng.integers(0, len(statements), 150)]
    attempts = [(k, g, code(g, t) if k % 2 else say(30)) for k, (g, t) in enumerate(own)] + [(500, 0, None), (501, 0, ""), (502, 9, say(9))]
    s = spark.createDataFrame(statements, "group_id int, statement string")
    a = spark.createDataFrame(attempts, "attempt_id int, group_id int, code string")
    kept = s.select("group_id", T.skeleton(F.col("statement")).alias("c")).collect()
    clean = {r.attempt_id: (r.group_id, r.c) for r in a.select("attempt_id", "group_id", T.without_comments(F.col("code"), "line_start").alias("c")).collect()}
    want = {i: int(any(r.group_id == g and g is not None and r.c and c is not None and all(x in c for x in r.c) for r in kept)) for i, (g, c) in clean.items()}
    assert {r.attempt_id: r.stmt_ok for r in P.aligned_with_any(a, s).collect()} == want and 20 < sum(want.values()) < 150

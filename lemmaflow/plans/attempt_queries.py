"""Registered queries over attempts, statements, plans for what is still to do, and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import answers as A
from lemmaflow.functions import sql
from lemmaflow.functions import text as T
from lemmaflow.operators import attempts as P
from lemmaflow.operators import compare, metrics, resampling, rounds, select
from lemmaflow.plans import views
from lemmaflow.plans.queries import _HITS, _hits, _rounded, query
from lemmaflow.sources import databases, readers

_FLAGGED = "flagged AS (SELECT *, CAST(price > 20000 AS INTEGER) AS stmt_ok FROM attempts)"
_GROUPS = f"{_FLAGGED}, groups AS (SELECT group_id, method, count(*) AS attempts, max(pass_ok) AS pass, max(complete_ok) AS complete, max(complete_ok * stmt_ok) AS aligned FROM flagged GROUP BY ALL)"


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return views.attempts(spark, sf).withColumn("stmt_ok", (F.col("price") > 20000).cast("int"))


@query(
    """WITH d AS (SELECT doc_id, text, doc_id % 20 AS g FROM documents WHERE text IS NOT NULL), clean AS (
        SELECT doc_id, g, list_aggregate(list_filter(string_split(regexp_replace(text, '(?s)/-.*?-/', '', 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^[ \\t\\x0B\\f\\r]*--')), 'string_agg', chr(10)) AS code FROM d),
    s AS (SELECT item_id, item_id % 20 AS g, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS chunks FROM benchmark),
    hit AS (SELECT DISTINCT doc_id FROM clean JOIN s USING (g) WHERE len(chunks) > 0 AND len(list_filter(chunks, lambda c: NOT contains(code, c))) = 0)
    SELECT doc_id AS attempt_id, CAST(hit.doc_id IS NOT NULL AS INTEGER) AS stmt_ok FROM documents LEFT JOIN hit USING (doc_id)"""
)
def aligned_with_any(spark, sf):
    a = views.table(spark, sf, "documents").select(F.col("doc_id").alias("attempt_id"), (F.col("doc_id") % 20).alias("group_id"), F.col("text").alias("code"))
    s = views.table(spark, sf, "benchmark").select((F.col("item_id") % 20).alias("group_id"), F.col("text").alias("statement"))
    return P.aligned_with_any(a, s)


@query(
    """WITH s AS (SELECT min(text) AS statement, item_id FROM benchmark GROUP BY item_id), j AS (
        SELECT d.doc_id, d.doc_id % 7 AS method, s.statement, d.text FROM documents d LEFT JOIN s ON s.item_id = d.doc_id)
    SELECT method, count(*) AS attempts, CAST(sum(CAST(statement IS NOT NULL AS INTEGER)) AS BIGINT) AS aligned FROM j GROUP BY method"""
)
def aligned_counts(spark, sf):
    s = views.table(spark, sf, "benchmark").groupBy(F.col("item_id").alias("base_id")).agg(F.min("text").alias("statement"))
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("base_id"), (F.col("doc_id") % 7).alias("method"), "text")
    rows = d.join(s, "base_id", "left").withColumn("code", F.concat_ws("\n", "text", "statement")).drop("statement")
    return P.aligned(rows, s).groupBy("method").agg(F.count("*").alias("attempts"), F.sum("stmt_ok").alias("aligned"))


@query(f"WITH {_GROUPS} SELECT * FROM groups", "attempts")
def group_sets(spark, sf):
    return P.group_sets(_flagged(spark, sf))


_INDEX = "problems AS (SELECT group_id, max(CAST(suite <> '5-LOW' AS INTEGER)) AS active FROM expected GROUP BY group_id)"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    allocated = F.when(F.col("suite") != "5-LOW", F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return P.problem_sets(views.expected(spark, sf).withColumn("allocations", allocated))


@query(
    f"""WITH {_GROUPS}, {_INDEX}, grid AS (SELECT p.group_id, active, m.method, coalesce(pass, 0) AS pass, coalesce(complete, 0) AS complete, coalesce(aligned, 0) AS aligned
        FROM problems p CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS method) m LEFT JOIN groups g ON g.group_id = p.group_id AND g.method = m.method),
    long AS (SELECT method, active, 'pass' AS field, pass AS hit FROM grid UNION ALL SELECT method, active, 'complete', complete FROM grid UNION ALL SELECT method, active, 'aligned', aligned FROM grid)
    SELECT method, field, count(*) AS problems, CAST(sum(hit) AS BIGINT) AS solved, CAST(sum(active) AS BIGINT) AS problems_active, CAST(sum(hit * active) AS BIGINT) AS solved_active,
           round(sum(hit) / count(*), 6) AS ratio, round(coalesce(sum(hit * active) / nullif(sum(active), 0), 0), 6) AS ratio_active FROM long GROUP BY method, field""",
    "attempts", "expected",
)
def utility_table(spark, sf):
    return _rounded(P.utility_table(P.group_sets(_flagged(spark, sf)), _index(spark, sf), [0, 1, 2, 3]))


@query(
    f"""WITH {_FLAGGED}, seen AS (SELECT group_id, count(*) AS attempts, max(pass_ok) AS a, max(complete_ok) AS b, max(pass_ok * stmt_ok) AS c, max(complete_ok * stmt_ok) AS d FROM flagged GROUP BY group_id),
    t AS (SELECT count(*) AS problems, CAST(sum(coalesce(attempts, 0)) AS BIGINT) AS attempts, max(coalesce(attempts, 0)) AS max_attempts, CAST(sum(coalesce(a, 0)) AS BIGINT) AS passed, CAST(sum(coalesce(b, 0)) AS BIGINT) AS completed,
        CAST(sum(coalesce(c, 0)) AS BIGINT) AS strict_passed, CAST(sum(coalesce(d, 0)) AS BIGINT) AS strict_completed FROM expected LEFT JOIN seen USING (group_id))
    SELECT *, round(passed / problems, 6) AS passed_ratio, round(completed / problems, 6) AS completed_ratio, round(strict_passed / problems, 6) AS strict_passed_ratio, round(strict_completed / problems, 6) AS strict_completed_ratio FROM t""",
    "attempts", "expected",
)
def attempt_summary(spark, sf):
    return _rounded(P.attempt_summary(_flagged(spark, sf), views.expected(spark, sf)))


@query(f"WITH {_GROUPS} SELECT group_id FROM groups WHERE method = 0 INTERSECT SELECT group_id FROM groups WHERE method = 1", "attempts")
def both_active(spark, sf):
    return P.both_active(P.group_sets(_flagged(spark, sf)), 0, 1)


@query(
    f"""WITH {_HITS} SELECT method, count(*) AS problems, round(avg(passes / attempts), 6) AS density FROM hits WHERE attempts > 0 AND group_id IN (SELECT group_id FROM expected WHERE suite = '1-URGENT') GROUP BY method""",
    "attempts", "expected",
)
def subset_density(spark, sf):
    return _rounded(compare.subset_density(_hits(spark, sf), views.expected(spark, sf).where("suite = '1-URGENT'")))


@query(
    f"""WITH {_HITS}, p AS (SELECT a.passes / a.attempts AS x, b.passes / b.attempts AS y FROM hits a JOIN hits b USING (group_id) WHERE a.method = 0 AND b.method = 1 AND a.passes > 0 AND b.passes > 0)
    SELECT count(*) AS problems, round(avg(x), 6) AS density_a, round(avg(y), 6) AS density_b, round(avg(x - y), 6) AS difference FROM p""",
    "attempts", "expected",
)
def common_correct(spark, sf):
    return _rounded(compare.common_correct(_hits(spark, sf), 0, 1))


_RECORDS = """records AS (SELECT l_orderkey AS origin, CAST(l_linenumber - 1 AS INTEGER) AS g, min(CASE WHEN l_returnflag = 'R' THEN 'HTTP 503 from server' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'bad answer' ELSE '' END) AS error,
    CAST(min(l_quantity) AS INTEGER) % 3 AS infra_retry, CASE WHEN min(l_discount) < 0.05 THEN 100 ELSE 200 END AS max_tokens, CASE WHEN min(l_tax) > 0.02 THEN 'text' ELSE ' ' END AS model_output FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    error = F.when(F.col("l_returnflag") == "R", "HTTP 503 from server").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "bad answer").otherwise("")
    return li.groupBy(F.col("l_orderkey").alias("origin"), (F.col("l_linenumber") - 1).cast("int").alias("g")).agg(
        F.min(error).alias("error"), (F.min("l_quantity").cast("int") % 3).alias("infra_retry"),
        F.when(F.min("l_discount") < 0.05, 100).otherwise(200).alias("max_tokens"), F.when(F.min("l_tax") > 0.02, "text").otherwise(" ").alias("model_output"), F.lit("None").alias("full_code"),
    )


@query(
    f"""WITH {_RECORDS}, slots AS (SELECT o_orderkey AS origin, CAST(unnest(range(8)) AS INTEGER) AS g FROM orders)
    SELECT origin, g FROM slots LEFT JOIN records r USING (origin, g)
    WHERE r.error IS NULL OR (max_tokens <> 100 AND NOT (error = '' AND trim(model_output) <> '')) OR (error LIKE '%503%' AND greatest(infra_retry, 1) < 2)"""
)
def resume_targets(spark, sf):
    wanted = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("origin"), F.lit(8).alias("n"))
    return P.resume_targets(wanted, _records(spark, sf), [r"HTTP\s+5\d\d", "timed out"], 2, 100)


_NAMED = "named AS (SELECT l_orderkey AS group_id, l_orderkey || '__m__k' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS name, min(l_partkey) AS part, max(l_returnflag) AS flag, max(l_linestatus) AS status, min(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(
    f"""WITH {_NAMED}, solved AS (SELECT DISTINCT group_id FROM named WHERE status = 'F' AND flag = 'A' AND quantity > 40)
    SELECT group_id, name, CASE WHEN status = 'O' THEN 'new' WHEN part % 10 = 0 THEN 'changed' ELSE 'system_error' END AS reason FROM named
    WHERE group_id NOT IN (SELECT group_id FROM solved) AND (status = 'O' OR part % 10 = 0 OR flag = 'R')"""
)
def recompile_plan(spark, sf):
    li = views.table(spark, sf, "lineitem")
    name = T.attempt_id(F.col("l_orderkey"), F.lit("m"), F.col("l_linenumber"))
    rows = li.groupBy(F.col("l_orderkey").alias("group_id"), name.alias("name")).agg(F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.min("l_quantity").alias("quantity"))
    code = F.concat(F.lit("theorem t : "), F.col("part").cast("string"))
    old = rows.where("status = 'F'").select("name", F.when(F.col("part") % 10 == 0, F.lit("theorem t")).otherwise(code).alias("code"), F.when(F.col("flag") == "R", "no server").alias("system_error"), ((F.col("flag") == "A") & (F.col("quantity") > 40)).cast("int").alias("complete_ok"))
    return P.recompile_plan(rows.select("group_id", "name", code.alias("code")), old)


@query(
    """WITH gone AS (SELECT o_orderkey AS task, CAST(unnest(range(9)) AS INTEGER) AS sample FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey, CAST(l_linenumber AS INTEGER) FROM lineitem),
    i AS (SELECT *, sample - row_number() OVER (PARTITION BY task ORDER BY sample) AS isle FROM gone)
    SELECT task, count(*) AS missing, count(DISTINCT isle) AS ranges, min(sample) AS first_missing, max(sample) AS last_missing FROM i GROUP BY task"""
)
def missing_samples(spark, sf):
    tasks = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), F.lit(9).alias("n"), (F.col("o_orderstatus") == "F").alias("finished"))
    return P.missing_samples(tasks, views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("int").alias("sample")))


@query(
    "SELECT group_id, k_idx, supp, part, CAST(row_number() OVER (PARTITION BY group_id ORDER BY k_idx, supp, CAST(part AS VARCHAR), price) AS INTEGER) AS place FROM attempts QUALIFY place <= 3",
    "attempts",
)
def ordered_attempts(spark, sf):
    a = views.attempts(spark, sf).select("group_id", "k_idx", "supp", "part", F.col("k_idx").alias("k"), F.col("supp").alias("g"), F.struct(F.col("part").cast("string"), "price").alias("name"))
    return P.in_order(a, ["group_id"]).where("place <= 3").select("group_id", "k_idx", "supp", "part", "place")


@query("SELECT l_orderkey AS group_id, count(*) AS total_attempts, count(*) FILTER (l_returnflag <> 'N') AS pass_attempts, count(*) FILTER (l_linestatus = 'F') AS complete_attempts, count(*) FILTER (l_quantity > 25) AS theorem_complete_attempts FROM lineitem GROUP BY l_orderkey")
def nested_counts(spark, sf):
    one = F.struct((F.col("l_returnflag") != "N").alias("pass"), (F.col("l_linestatus") == "F").alias("complete"), (F.col("l_quantity") > 25).alias("theorem_complete"))
    return P.nested_counts(views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.collect_list(one).alias("attempts")))


@query(
    "WITH p AS (SELECT problem_id, least(count(*) FILTER (semantic_ok = 1), 8) AS selected, problem_id % 10 = 0 AS skipped FROM programs GROUP BY problem_id) SELECT CAST(sum(CAST(NOT skipped AS INTEGER)) AS BIGINT) AS processed, CAST(sum(CAST(NOT skipped AND selected = 0 AS INTEGER)) AS BIGINT) AS zero_selected, CAST(sum(CAST(NOT skipped AND selected < 8 AS INTEGER)) AS BIGINT) AS under_k, CAST(sum(CAST(skipped AS INTEGER)) AS BIGINT) AS skipped, CAST(sum(CASE WHEN skipped THEN 0 ELSE selected END) AS BIGINT) AS written FROM p",
    "programs",
)
def selection_stats(spark, sf):
    p = views.programs(spark, sf).groupBy("problem_id").agg(F.least(F.sum("semantic_ok"), F.lit(8)).alias("selected")).withColumn("skipped", F.col("problem_id") % 10 == 0)
    return P.selection_stats(p, 8)


@query("SELECT count(*) AS attempted, CAST(sum(compile_ok) AS BIGINT) AS solved, round(sum(compile_ok) / count(*), 6) AS rate FROM programs", "programs")
def compile_audit(spark, sf):
    return _rounded(P.success_summary(views.programs(spark, sf), "compile_ok"))


@query(
    "SELECT doc_id AS diff_id, 'f' || doc_id AS file, CAST(greatest(p - m, 0) AS BIGINT) AS added, CAST(greatest(m - p, 0) AS BIGINT) AS deleted, CAST(least(p, m) AS BIGINT) AS modified FROM (SELECT doc_id, (len(string_split(text, chr(10))) + 2) // 3 AS p, len(string_split(text, chr(10))) // 3 AS m FROM documents WHERE text IS NOT NULL)"
)
def diff_counts(spark, sf):
    d = views.table(spark, sf, "documents").where("text is not null")
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit(" "), F.lit("-")), (i % 3 + 1).cast("int")), x))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return P.diff_counts(d.select(F.col("doc_id").alias("diff_id"), F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,2 +1,2 @@\n"), F.array_join(marked, "\n")).alias("diff")))


@query(
    """SELECT doc_id, n_chars % 5 IN (0) AS level1, n_chars % 5 IN (0, 1, 2) AS level2, n_chars % 5 IN (0, 1, 2, 3) AS level3 FROM documents WHERE text IS NOT NULL"""
)
def trivial_statements(spark, sf):
    d = views.table(spark, sf, "documents").where("text is not null")
    kind = F.element_at(F.array(F.lit("True"), F.lit("(n : Nat) → True"), F.lit("∀ x, True"), F.lit("(x) = x"), F.lit("n + 0 = n")), (F.col("n_chars") % 5 + 1).cast("int"))
    code = F.concat(F.lit("import Mathlib\n/- "), F.regexp_replace("text", "-/", ""), F.lit(" -/\ntheorem t (h : a) : "), kind, F.lit(" := by\n  sorry -- done"))
    return d.select("doc_id", *[T.is_trivial(code, k).alias(f"level{k}") for k in (1, 2, 3)])


#: What a judge might have said about a turn: raw text, or a text around JSON of the turn's own words, broken off or whole.
_SAID = """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, CAST(conv_id * 7 + turn AS BIGINT) % 6 AS how, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'incorrect' ELSE 'Correct' END AS word FROM conversations), o AS (
    SELECT conv_id, turn, how, CASE how
        WHEN 0 THEN text
        WHEN 1 THEN '{"a": {"b": {"c": [1, {"d": "}"}]}}, "reasons": ' || to_json(text) || ', "is_assistant_correct": "' || word || '"}'
        WHEN 2 THEN replace(text, '"', ' ') || chr(10) || 'is it {this}? {"a": {"b": {"c": {}}}, "is_assistant_correct": ["correct", "' || word || '"]} so'
        WHEN 3 THEN replace(replace(text, '"', ' '), '{', ' ') || chr(10) || '{"reasons": "cut", "is_assistant_correct": "' || word
        WHEN 4 THEN replace(text, '"', ' ') || chr(10) || 'the verdict "' || word || '" is final, ' || left(text, 40)
        ELSE text || chr(10) || '  ' || word || '  ' END AS said FROM c)"""


@query(
    _SAID
    + """, v AS (SELECT *, trim(said, ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM o), j AS (
        SELECT *, json_valid(clean) AND clean LIKE '{%' AS whole, regexp_extract(clean, '(?s)[{]"a".*[}]') AS part, regexp_extract_all(clean, '(?i)\\b(correct|incorrect)\\b') AS words FROM v)
    SELECT conv_id, turn, CASE WHEN len(words) > 0 THEN upper(left(words[-1], 1)) || lower(substring(words[-1], 2)) END AS verdict,
        CASE WHEN whole AND json_extract(clean, '$.is_assistant_correct') IS NOT NULL THEN 'json' WHEN json_valid(part) AND json_extract(part, '$.is_assistant_correct') IS NOT NULL THEN 'extracted_json'
             WHEN regexp_matches(clean, 'is_assistant_correct') THEN 'salvaged_key' WHEN len(words) > 0 THEN 'salvaged_word' ELSE 'failed' END AS method,
        CASE WHEN whole THEN coalesce(nullif(trim(json_extract_string(clean, '$.reasons'), ' ' || chr(9) || chr(10) || chr(13)), ''), clean) WHEN len(words) > 0 THEN clean WHEN clean = '' THEN '[ParseError] Empty model output' ELSE '[ParseError] Could not extract verdict' || chr(10) || clean END AS reasons
    FROM j"""
)
def judge_verdicts(spark, sf):
    c = views.table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    c = c.withColumns({"how": (F.col("conv_id") * 7 + F.col("turn")) % 6, "word": F.when(F.length("text") % 3 == 0, "incorrect").otherwise("Correct")})
    quoted = F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)")
    bare = F.replace(F.col("text"), F.lit('"'), F.lit(" "))
    parts = {
        1: (F.lit('{"a": {"b": {"c": [1, {"d": "}"}]}}, "reasons": '), quoted, F.lit(', "is_assistant_correct": "'), F.col("word"), F.lit('"}')),
        2: (bare, F.lit('\nis it {this}? {"a": {"b": {"c": {}}}, "is_assistant_correct": ["correct", "'), F.col("word"), F.lit('"]} so')),
        3: (F.replace(bare, F.lit("{"), F.lit(" ")), F.lit('\n{"reasons": "cut", "is_assistant_correct": "'), F.col("word")),
        4: (bare, F.lit('\nthe verdict "'), F.col("word"), F.lit('" is final, '), F.left("text", F.lit(40))),
        5: (F.col("text"), F.lit("\n  "), F.col("word"), F.lit("  ")),
    }
    said = F.col("text")
    for how, pieces in parts.items():
        said = F.when(F.col("how") == how, F.concat(*pieces)).otherwise(said)
    return c.withColumn("v", A.verdict(said)).select("conv_id", "turn", "v.verdict", "v.method", "v.reasons")


@query(
    """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM conversations), g AS (SELECT conv_id, turn, count(*) AS n FROM t GROUP BY ALL)
    SELECT c.conv_id, c.turn, CAST(s.g AS INTEGER) AS g, length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS folded_chars
    FROM conversations c LEFT JOIN g USING (conv_id, turn), LATERAL (SELECT unnest(range(coalesce(n, 0) // 50)) AS g) s"""
)
def sql_attempt_slots(spark, sf):
    """Table and scalar functions called in SQL: a slot for every 50 words of a turn."""
    sql.register(spark)
    views.table(spark, sf, "conversations").createOrReplaceTempView("_turns")
    return spark.sql(
        """SELECT conv_id, turn, g, length(folded_text(text)) AS folded_chars
        FROM (SELECT *, CAST(size(filter(split(folded_text(text), ' '), w -> w <> '')) div 50 AS INT) AS n FROM _turns), LATERAL attempt_slots(n)"""
    )


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS x, coalesce(b.text, '') AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    t AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_'']*|[0-9]+|[^ \\t\\n\\x0B\\f\\r]')) AS token, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(y, '[A-Za-z_][A-Za-z0-9_'']*|[0-9]+|[^ \\t\\n\\x0B\\f\\r]')), 0, 1 FROM p)
    SELECT conv_id, turn, token, CAST(sum(a) AS BIGINT) AS parent_n, CAST(sum(b) AS BIGINT) AS child_n FROM t GROUP BY conv_id, turn, token HAVING sum(a) <> sum(b)"""
)
def sql_token_changes(spark, sf):
    """A table function of two texts, called in SQL for every turn and the next."""
    sql.register(spark)
    _pairs(spark, sf).createOrReplaceTempView("_turn_pairs")
    return spark.sql("SELECT conv_id, turn, token, parent_n, child_n FROM _turn_pairs, LATERAL token_changes(text, child)")


@query(
    """WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') END AS x, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') END AS y FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '[\\x0B\\f\\r\\x1C-\\x1E]')),
    n AS (SELECT *, x IS NOT NULL AND y IS NOT NULL AS ok, length(trim(regexp_replace(x, '[ \\t\\n]+', ' ', 'g'))) AS chars, len(regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_'']*|[0-9]+|[^ \\t\\n]')) AS tokens FROM b)
    SELECT conv_id, turn, ok, CASE WHEN NOT ok THEN 'missing_evolve_block' END AS reason, x IS NOT NULL AS parent_has_block, y IS NOT NULL AS child_has_block, CASE WHEN ok THEN chars END AS parent_chars, CASE WHEN ok THEN chars + CASE WHEN chars = 0 THEN 5 ELSE 6 END END AS child_chars,
        CASE WHEN ok THEN tokens END AS parent_tokens, CASE WHEN ok THEN tokens + 1 END AS child_tokens, CASE WHEN ok THEN CAST(1 AS BIGINT) END AS added, CASE WHEN ok THEN CAST(0 AS BIGINT) END AS removed FROM n"""
)
def marked_changes(spark, sf):
    """Marked blocks of a text and of the text with a word more; every third and every second turn has one."""
    c = views.table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).where(~F.col("text").rlike(r"[\x0B\f\r\x1C-\x1E]"))
    marked = lambda k, more: F.concat(F.lit("head\n"), F.when(F.col("turn") % k == 0, "-- EVOLVE-BLOCK-START\n").otherwise(""), "text", F.lit(f"\n{more}\n  EVOLVE-BLOCK-END\nbye"))
    pairs = c.select("conv_id", "turn", marked(3, "").alias("a"), marked(2, "added").alias("b"))
    return A.change_stats(pairs, ["conv_id", "turn"], "a", "b", marked=True).drop("token_jaccard", "length_ratio", "sequence_ratio")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("child"))
    return c.join(nxt, ["conv_id", "turn"])


@query(
    """WITH p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS x, coalesce(b.text, '') AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
    bare AS (SELECT conv_id, turn, regexp_replace(x, '\\b(theorem|lemma|def|example|abbrev|opaque|axiom|instance)[ \\t\\n\\x0B\\f\\r]+[A-Za-z0-9_'']+', '\\1 _NAME_', 'g') AS x, regexp_replace(y, '\\b(theorem|lemma|def|example|abbrev|opaque|axiom|instance)[ \\t\\n\\x0B\\f\\r]+[A-Za-z0-9_'']+', '\\1 _NAME_', 'g') AS y FROM p),
    t AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_'']*|[0-9]+|[^ \\t\\n\\x0B\\f\\r]')) AS t, 1 AS a, 0 AS b FROM bare UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(y, '[A-Za-z_][A-Za-z0-9_'']*|[0-9]+|[^ \\t\\n\\x0B\\f\\r]')), 0, 1 FROM bare),
    n AS (SELECT conv_id, turn, t, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL), s AS (SELECT conv_id, turn, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS common FROM n GROUP BY ALL),
    w AS (SELECT p.conv_id, p.turn, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(common, 0) AS common FROM p LEFT JOIN s ON s.conv_id = p.conv_id AND s.turn = p.turn)
    SELECT conv_id, turn, CAST(a AS BIGINT) AS parent_tokens, CAST(b AS BIGINT) AS child_tokens, round(coalesce(common / nullif(a + b - common, 0), 1), 6) AS token_jaccard, CAST(b - common AS BIGINT) AS added, CAST(a - common AS BIGINT) AS removed, round(b / greatest(a, 1), 6) AS length_ratio FROM w"""
)
def token_changes(spark, sf):
    return _rounded(A.change_stats(_pairs(spark, sf), ["conv_id", "turn"], "text", "child").select("conv_id", "turn", "parent_tokens", "child_tokens", "token_jaccard", "added", "removed", "length_ratio"))


@query(None)
def change_stats(spark, sf):
    return A.change_stats(_pairs(spark, sf), ["conv_id", "turn"], "text", "child")


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'lean_fence' ELSE 'no_fence' END AS source, 'n' || turn AS name FROM conversations"
)
def best_blocks(spark, sf):
    c = views.table(spark, sf, "conversations")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+|`|-", " ")
    theorem = F.concat(F.lit("theorem n"), F.col("turn").cast("string"), F.lit(" : True := by sorry"))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("-- a\n```lean\ntheorem old : 1 = 2 := by sorry\n```\n"), words, F.lit("\n```lean4\n"), theorem, F.lit("\n```"))).otherwise(F.concat(F.lit("theorem old : 1 = 2 := by sorry\n"), words, F.lit("\n"), theorem, F.lit("\nthat is it")))
    return c.withColumn("b", A.best_block(answer)).select("conv_id", "turn", "b.source", T.theorem_name(F.col("b.code")).alias("name"))


@query("SELECT c_custkey AS run, CASE WHEN c_mktsegment = 'BUILDING' THEN 'normal_completion' WHEN c_mktsegment = 'MACHINERY' THEN 'budget_exhausted' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'exploration_stagnation' ELSE 'unknown' END AS failure FROM customer")
def termination_classes(spark, sf):
    reason = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("max_evals reached by "), "c_name")).when(F.col("c_mktsegment") == "HOUSEHOLD", "stagnation for 5").when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), metrics.termination_class(reason).alias("failure"))


@query("SELECT o_orderkey AS run, o_custkey + 5 AS total, greatest(o_custkey - o_orderkey % 100 - 3, 0) AS patch FROM orders")
def call_accounting(spark, sf):
    c = metrics.call_accounting(F.col("o_custkey"), F.lit(5), F.col("o_orderkey") % 100, F.lit(3))
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), c["total"].alias("total"), c["patch"].alias("patch"))


@query(
    "SELECT event_type AS error_type, count(*) AS failures, count(*) FILTER (event_id % 3 = 0) AS repair_success, count(*) FILTER (event_id % 3 = 1) AS repair_exhausted, count(*) FILTER (event_id % 3 = 2) AS no_repair, CAST(sum(user_id % 4) AS BIGINT) AS repair_attempts FROM events GROUP BY event_type"
)
def failure_table(spark, sf):
    state = F.element_at(F.array(F.lit("repair_success"), F.lit("repair_exhausted"), F.lit("no_repair")), (F.col("event_id") % 3 + 1).cast("int"))
    return metrics.failure_table(views.table(spark, sf, "events").select(F.col("event_type").alias("error_type"), state.alias("final_status"), (F.col("user_id") % 4).alias("repair_attempts")))


@query(
    "SELECT 'naive' AS method, count(*) AS problems, round(avg(c_acctbal), 6) AS mean_reward, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE WHEN c_acctbal <= -500 THEN NULL ELSE 0 END), 6) AS mean_success FROM customer UNION ALL SELECT 'evolve', count(*), round(avg(c_nationkey), 6), round(avg(CAST(c_nationkey > 12 AS DOUBLE)), 6) FROM customer"
)
def method_means(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_acctbal").alias("naive_reward"), F.when(F.col("c_acctbal") > 0, 1).when(F.col("c_acctbal") > -500, 0).alias("naive_success"), F.col("c_nationkey").alias("evolve_reward"), (F.col("c_nationkey") > 12).alias("evolve_success"))
    return _rounded(metrics.method_means(c, ["naive", "evolve"], ["reward", "success"]))


@query(
    """WITH e AS (SELECT *, event_type <> 'error' AS ok FROM events) SELECT user_id AS program_id, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS valid_runs, CAST(sum(CAST(NOT ok AS INTEGER)) AS BIGINT) AS invalid_runs, arg_min(props, event_id) FILTER (NOT ok) AS first_error,
    count(DISTINCT props) FILTER (NOT ok) AS errors, round(avg(value), 4) AS mean_seconds, round(stddev_pop(value), 4) AS deviation_seconds FROM e GROUP BY user_id"""
)
def repeated_runs(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("program_id"), F.col("event_id").alias("run"), (F.col("event_type") != "error").alias("valid"), F.col("props").alias("error"), F.col("value").alias("seconds"))
    return metrics.repeated_runs(e).withColumns({"errors": F.size("errors").cast("long"), "mean_seconds": F.round("mean_seconds", 4), "deviation_seconds": F.round("deviation_seconds", 4)})


@query(None)
def correlation_p(spark, sf):
    rows = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents"), "doc_id")
    return resampling.correlation_p(rows, "n_chars", "quality")


@query(
    "SELECT doc_id AS id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 5) AND NOT contains(text, 'sorry')"
)
def allowed_candidates(spark, sf):
    d = views.table(spark, sf, "documents")
    listed = d.groupBy("source").count().where("count >= 5").select("source")
    rows = select.admitted(d.where("text is not null"), listed, header="text", key="source")
    return rows.where("skipped is null").select(F.col("doc_id").alias("id"))


@query(
    """SELECT CASE WHEN lang = 'fr' THEN 'not_listed' WHEN doc_id >= 700 THEN 'beyond_first' WHEN contains(coalesce(text, ''), 'License') THEN 'header' ELSE 'kept' END AS reason, count(*) AS "rows" FROM documents GROUP BY 1"""
)
def skipped_candidates(spark, sf):
    """Why candidates are left out: problem not listed, beyond the first 700, a forbidden word."""
    d = views.table(spark, sf, "documents")
    return select.skipped_counts(select.admitted(d, d.where("lang <> 'fr'"), 700, "text", "License", key="lang", index="doc_id"))


@query(
    """WITH p AS (SELECT problem_id, id, CASE WHEN id % 11 = 0 THEN CAST('-inf' AS DOUBLE) ELSE -combined_score END AS lp, length(public_metrics) AS n FROM programs),
    s AS (SELECT problem_id, id, lp / nullif(n, 0) AS score FROM p), u AS (SELECT *, CASE WHEN score > CAST('-inf' AS DOUBLE) THEN score END AS usable FROM s),
    e AS (SELECT problem_id, id, row_number() OVER (PARTITION BY problem_id ORDER BY usable DESC NULLS LAST, id) AS "rank", exp((greatest(coalesce(usable, -1e9), -1e9) - max(greatest(coalesce(usable, -1e9), -1e9)) OVER (PARTITION BY problem_id)) / 3.5) AS e FROM u)
    SELECT problem_id, id, CAST("rank" AS INTEGER) AS "rank", round(e / sum(e) OVER (PARTITION BY problem_id), 6) AS probability FROM e""",
    "programs",
)
def likelihood_ranks(spark, sf):
    p = views.programs(spark, sf)
    p = p.withColumns({"lp": F.when(F.col("id") % 11 == 0, float("-inf")).otherwise(-F.col("combined_score")), "n": F.length("public_metrics")})
    return _rounded(select.likelihood_ranks(p, ["problem_id"], "lp", "n").select("problem_id", "id", "rank", "probability"))


@query(
    "SELECT 'r' || (problem_id % 8) AS run_id, id AS seq, CAST(id AS VARCHAR) AS id, CAST(id % 50 AS INTEGER) AS generation, combined_score, CAST(compile_ok = 1 AS BOOLEAN) AS correct FROM programs WHERE public_metrics IS NOT NULL AND id % 50 >= 10 AND compile_ok = 1",
    "programs",
)
def stored_programs(spark, sf):
    """Programs written to a database for each run and read back from there, with conditions that go to the databases."""
    p = views.programs(spark, sf)
    rows = p.select(
        F.concat(F.lit("r"), (F.col("problem_id") % 8).cast("string")).alias("run_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), (F.col("id") % 50).cast("int").alias("generation"),
        "combined_score", "public_metrics", (F.col("compile_ok") == 1).alias("correct"),
    )
    place = rounds.folder(spark)
    databases.write_databases(rows, place)
    return databases.run_databases(spark, place, rows=500).where("generation >= 10 and correct").select("run_id", "seq", "id", "generation", "combined_score", "correct")


@query(
    """SELECT 'c' || conv_id || '_t' || turn AS name, CAST(turn % 2 = 0 AS INTEGER) AS pass_ok, CAST(turn % 4 = 0 AS INTEGER) AS complete_ok, coalesce(text, '') AS info, CAST(turn % 3 AS INTEGER) AS sorries FROM conversations"""
)
def compile_arrays(spark, sf):
    """Compile results in pretty-printed JSON arrays, one for each conversation, read by pieces."""
    c = views.table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    sorry = F.struct(F.lit("error }").alias("severity"), F.lit("{ a ]").alias("data"))
    result = F.struct((F.col("turn") % 2 == 0).alias("pass"), (F.col("turn") % 4 == 0).alias("complete"), F.array(F.struct(F.col("text").alias("data"))).alias("infos"), F.array_repeat(sorry, (F.col("turn") % 3).cast("int")).alias("sorries"))
    entry = F.struct(F.format_string("c%d_t%d", "conv_id", "turn").alias("name"), F.col("text").alias("code"), result.alias("compilation_result"))
    place = rounds.folder(spark)
    c.groupBy("conv_id").agg(F.to_json(F.collect_list(entry), {"pretty": "true"}).alias("value")).select("value").write.text(place)  # a conversation's turns
    return readers.compile_results(spark, place).select("name", "pass_ok", "complete_ok", F.get("infos", F.lit(0))["data"].alias("info"), F.size("sorries").alias("sorries"))


@query(
    """WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'at /home/u' || conv_id || '/run.py: ' || coalesce(text, '') || ' or /Users/me' AS message, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || chr(10) || '5. Accuracy  confirmation: ' || coalesce(text, '') ELSE coalesce(text, '') END AS reasons FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '... [truncated]' END AS short, regexp_replace(message, '/(?:home|Users)/[^\\\\s:''"`]+', '[REDACTED_PATH]', 'g') AS redacted,
    CASE WHEN turn % 2 = 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END AS accuracy FROM m"""
)
def judge_texts(spark, sf):
    """Messages cut and without home paths, and what a judge says under its fifth heading."""
    c = views.table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    message = F.concat(F.lit("at /home/u"), F.col("conv_id").cast("string"), F.lit("/run.py: "), "text", F.lit(" or /Users/me"))
    reasons = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n5. Accuracy  confirmation: "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.truncated(F.col("text"), 200).alias("short"), T.redacted(message).alias("redacted"), T.accuracy_section(reasons).alias("accuracy"))


@query(
    """SELECT id, 'import Mathlib' || chr(10) || chr(10) || '-- ' || problem_id AS preamble, rtrim(split_part(code, chr(10), 4)) AS theorem, 't' || id AS name, CAST(0 AS INTEGER) AS closed, 1 AS blocks, CAST(id % 2 AS INTEGER) AS other_is_open,
    CASE WHEN id % 3 = 0 THEN '' ELSE 'missing_required_import_lines' END AS imports FROM candidates""",
    "candidates",
)
def candidate_files(spark, sf):
    """Candidates' files taken apart: preamble, header and theorem, blocks; is the theorem of another name open?"""
    c = views.candidates(spark, sf)
    name = F.concat(F.lit("t"), F.col("id").cast("string"))
    more = F.when(F.col("id") % 2 == 0, F.concat(F.lit("theorem other : 1 = 1 := rfl"))).otherwise("")
    whole = F.concat(F.when(F.col("id") % 3 == 0, "import Mathlib\n -- EVOLVE-BLOCK-START\nimport Aesop\n").otherwise("import Aesop\n"), "code")
    parts = T.header_and_theorem(F.col("code"))
    return c.select(
        "id", parts["header"].alias("preamble"), parts["theorem"].alias("theorem"), T.theorem_name(F.col("code")).alias("name"), T.has_closed_block(F.col("code")).cast("int").alias("closed"),
        F.when(T.preamble(F.col("code")) == parts["header"], F.size(T.theorem_blocks(F.col("code")))).alias("blocks"), T.target_is_open(F.concat("code", more), F.lit("other")).cast("int").alias("other_is_open"), T.import_prefix(whole).alias("imports"),
    ).where(F.col("name") == name)


@query(
    """SELECT id, round(exp(coalesce(-combined_score / nullif(length(public_metrics), 0), -100) / 3.5), 8) AS cycle, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE combined_score END AS usable FROM programs""",
    "programs",
)
def cycle_scores(spark, sf):
    """Scores of log-probabilities per token, and numbers without those that are none."""
    p = views.programs(spark, sf)
    odd = F.when(F.col("id") % 5 == 0, float("inf")).when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("combined_score"))
    return p.select("id", F.round(metrics.cycle_score(-F.col("combined_score"), F.length("public_metrics")), 8).alias("cycle"), metrics.finite(odd).alias("usable"))


@query(
    """WITH m AS (SELECT conv_id, (turn + conv_id) % 3 AS kind, contains(coalesce(text, ''), 'declaration uses ''sorry''') OR turn % 4 = 1 AS sorry FROM conversations),
    c AS (SELECT conv_id, count(*) FILTER (kind = 0) AS errors, count(*) FILTER (kind = 1) AS warnings, count(*) FILTER (kind = 2) AS infos, count(*) FILTER (kind = 1 AND sorry) AS sorries FROM m GROUP BY conv_id)
    SELECT conv_id, errors = 0 AS passed, errors = 0 AND sorries = 0 AS complete, CAST(errors AS INTEGER) AS errors, CAST(warnings AS INTEGER) AS warnings, CAST(infos AS INTEGER) AS infos FROM c"""
)
def compiler_verdicts(spark, sf):
    """Verdicts of compiler messages, a conversation's turns being one compilation's messages."""
    c = views.table(spark, sf, "conversations")
    kind = (F.col("turn") + F.col("conv_id")) % 3
    severity = F.when(kind == 0, "Error").when(kind == 1, "warning").otherwise("info")
    data = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 4 == 1, " declaration uses 'sorry'").otherwise(""))
    own = c.groupBy("conv_id").agg(F.collect_list(F.struct(severity.alias("severity"), data.alias("data"))).alias("m"))  # a conversation's turns
    return own.select("conv_id", metrics.verdict(F.col("m")).alias("v")).select("conv_id", "v.*")


@query(
    r"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS code FROM documents), l AS (SELECT id, list_filter(string_split(code, chr(10)), lambda x: trim(x, ' ') <> '') AS rows, code FROM d)
    SELECT id, CAST(len(rows) AS INTEGER) AS loc, CAST(len(list_filter(rows, lambda x: regexp_matches(x, '^[ \t\x0B\f\r]*--'))) AS INTEGER) AS comments, CAST(len(regexp_extract_all(code, '\b(if|match|cases|induction|for|while)\b')) AS INTEGER) AS decisions FROM l"""
)
def text_complexity(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("code"))
    return d.select("id", T.complexity(F.col("code")).alias("c")).select("id", "c.loc", "c.comments", "c.decisions")


@query("SELECT problem_id, min(id) AS id FROM candidates GROUP BY problem_id", "candidates")
def first_candidates(spark, sf):
    return select.first_occurrence(views.candidates(spark, sf), ["problem_id"], "id").select("problem_id", "id")


@query(
    """SELECT doc_id AS id, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) = 0 THEN ''
        ELSE 'theorem t : p := by' || chr(10) || trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || chr(10) || '  done' || chr(10) END AS merged FROM documents"""
)
def merged_proofs(spark, sf):
    """A statement and the body of a proof of it, whose lines are indented by two."""
    d = views.table(spark, sf, "documents").withColumn("own", T.folded(F.coalesce("text", F.lit(""))))
    proof = F.when(F.col("own") != "", F.concat(F.lit("theorem t : p := by\n  "), "own", F.lit("\n    done"))).otherwise("")
    return d.select(F.col("doc_id").alias("id"), T.merged_proof(F.lit("theorem t : p := by sorry"), proof).alias("merged"))

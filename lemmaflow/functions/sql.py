"""Functions for SQL users: register(spark), then call them in any SQL text of the session.

    judge_verdict(output, finish)      struct (verdict, reasons, method)
    match_ratio(a, b)                  matching share of two texts
    marked_change(parent, child)       struct (ok, parent_tokens, child_tokens, added, removed, token_jaccard)
    folded_text(text)                  white space folded
    code_tokens(text)                  array of tokens, names of declarations left out
    attempt_slots(n)                   table function: g = 0 to n - 1
    fenced_blocks(answer)              table function: number, language and code of each fenced block
    token_changes(parent, child)       table function: each token with its counts, where they differ

Verdicts and ratios are Arrow batches; all others are SQL that the optimizer sees through. Null arguments count as
empty texts and as 0.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lemmaflow.functions import answers as A


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def statements() -> list[str]:
    tokens = lambda c: f"regexp_extract_all({c}, {_quoted(A.TOKEN)}, 0)"
    bare = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), {_quoted(A.NAMED)}, '$1 _NAME_'), r'\\s+', ' '))"
    # a text's tokens sorted (s), where runs of equal ones begin and the last ends (b): each token once, with its number and the text's
    ends = "filter(sequence(0, size(s)), i -> i = 0 OR i = size(s) OR s[i] <> s[i - 1])"
    counts = lambda c, k: f"transform(array(sort_array({tokens(bare(c))})), s -> transform(array({ends}), b -> transform(slice(b, 1, size(b) - 1), (p, j) -> named_struct('t', s[p], 'k', {k}, 'n', CAST(b[j + 1] - p AS BIGINT))))[0])[0]"
    # both texts' counts sorted (r): a token's count in the child, if it has one, comes right behind that in the parent
    of_both = "CASE WHEN x.k = 0 THEN named_struct('t', x.t, 'p', x.n, 'c', CASE WHEN get(r, j + 1).t = x.t THEN get(r, j + 1).n ELSE 0L END) WHEN j = 0 OR r[j - 1].t <> x.t THEN named_struct('t', x.t, 'p', 0L, 'c', x.n) END"
    changes = lambda a, b: f"transform(array(sort_array(concat({counts(a, 0)}, {counts(b, 1)}))), r -> filter(transform(r, (x, j) -> {of_both}), x -> x.p <> x.c))[0]"
    create = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{create} folded_text(text STRING) RETURNS STRING RETURN trim(regexp_replace(coalesce(text, ''), r'\\s+', ' '))",
        f"{create} code_tokens(text STRING) RETURNS ARRAY<STRING> RETURN {tokens(bare('text'))}",
        f"{create} attempt_slots(n INT) RETURNS TABLE(g INT) RETURN SELECT explode(CASE WHEN n > 0 THEN sequence(0, n - 1) ELSE CAST(array() AS ARRAY<INT>) END)",
        f"{create} fenced_blocks(answer STRING) RETURNS TABLE(number INT, language STRING, code STRING) RETURN SELECT pos, regexp_extract(col, r'^([^\\n]*)', 1), regexp_replace(col, r'^[^\\n]*\\n', '') FROM (SELECT posexplode(regexp_extract_all(coalesce(answer, ''), r'(?s)```([^\\n`]*\\n.*?)```', 1)))",
        f"{create} token_changes(parent STRING, child STRING) RETURNS TABLE(token STRING, parent_n BIGINT, child_n BIGINT) RETURN SELECT inline({changes('parent', 'child')})",
    ]


def register(spark: SparkSession) -> None:
    """All functions above for the session's SQL."""
    spark.udf.register("judge_verdict", A.verdict_udf())
    spark.udf.register("match_ratio", A.ratio_udf)
    spark.udf.register("marked_change", A.marked_change_udf())
    for statement in statements():
        spark.sql(statement)

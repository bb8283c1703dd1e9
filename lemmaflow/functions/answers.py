"""Functions over model answers and pairs of texts, in built-in expressions but for a judge's verdict (braces nest to
any depth) and the matching share of two texts, which need a scan: an Arrow batch at a time."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lemmaflow.functions import text as T

#: What counts as one token of code, and what as a declaration's name.
TOKEN = r"[A-Za-z_][A-Za-z0-9_']*|[0-9]+|\S"
NAMED = r"\b(theorem|lemma|def|example|abbrev|opaque|axiom|instance)\s+[A-Za-z0-9_']+"
#: The longest answer in which any verdict word counts; how far behind its key's colon one may stand (and the
#: colon behind the key, twice that in all); the end of an answer that is looked at first.
SHORT, REACH, TAIL = 512, 128, 4000
_WORD = re.compile(r"\b(correct|incorrect)\b", re.I)
#: Where a verdict word stands alone: a line of its own, in quotes, or at the very end as a value. Fixed values.
_ALONE = [
    re.compile(r"^\s*(correct|incorrect)\s*$", re.I | re.M),
    re.compile(r"[\"']\s*(correct|incorrect)\s*[\"']", re.I),
    re.compile(r"(?:^|[:\n])\s*(correct|incorrect)\b[\s}\]]*\Z", re.I),
]
#: A string with its escapes, open at the text's end perhaps, or a brace.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}]', re.S)
_VERDICT = StructType([StructField(n, StringType()) for n in ("verdict", "reasons", "method")])


def outer_braces(text: str) -> list[str]:
    """The outermost parts in braces, nested to any depth; braces inside strings do not count."""
    inside, opened, out = 0, None, []
    for mark in _MARKS.finditer(text):
        step = {"{": 1, "}": -1}.get(mark[0], 0)
        if step > 0 and not inside:
            opened = mark.start()
        inside = max(0, inside + step)
        if step < 0 and not inside and opened is not None:
            out.append(text[opened : mark.end()])
            opened = None
    return out


def _json_object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _ways(clean: str, key: str) -> Iterator[tuple[str, str, list[str]]]:
    """(method, reasons, verdict words) of every way to a verdict, the best first."""
    whole = _json_object(clean)
    for method, found in [("json", whole)] + [("extracted_json", _json_object(x)) for x in reversed(outer_braces(clean)) if x != clean]:
        if found:
            yield method, str(found.get("reasons") or "").strip() or clean, _WORD.findall(str(found.get(key) or ""))
    for place in reversed(list(re.finditer(rf"\b{re.escape(key)}\b", clean, re.I))):
        near = clean[place.end() : place.end() + 2 * REACH]
        yield "salvaged_key", clean, _WORD.findall(near.partition(":")[2][:REACH])
    if len(clean) <= SHORT:
        yield "salvaged_word", clean, _WORD.findall(clean)
    for text in (clean[-TAIL:], clean):
        for shape in _ALONE:
            yield "salvaged_word", clean, shape.findall(text)


def judged(output: str | None, finish: str | None = None, key: str = "is_assistant_correct") -> tuple[str | None, str, str]:
    """One output's (verdict, reasons, method); see verdict()."""
    clean = (output or "").strip()
    if "```" in clean:
        clean = re.sub(r"^```[\w-]*\s*", "", clean, flags=re.A).replace("```", "")
    clean = re.sub(r"^\s*json\s*", "", clean, flags=re.I).strip()
    for method, reasons, words in _ways(clean, key):
        if words:
            return words[-1].capitalize(), reasons, method
    why = f" (finish_reason={finish})" if finish else ""
    return None, f"[ParseError] Could not extract verdict{why}\n{clean}" if clean else f"[ParseError] Empty model output{why}", "failed"


def verdict_udf(key: str = "is_assistant_correct"):
    """verdict() as a function of outputs and of why the model stopped."""

    def batch(output: pd.Series, finish: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judged(x, why, key) for x, why in zip(output, finish)], columns=_VERDICT.names)

    return F.pandas_udf(batch, _VERDICT)


def verdict(output: Column, key: str = "is_assistant_correct", finish: Column | None = None) -> Column:
    """(verdict, reasons, method) of a judge's output, by the first way that finds one: the whole is
    JSON, the last JSON object in it that has the key, the last word behind the key, or a verdict word
    that stands alone (anywhere in a short output). No verdict: null, a diagnosis with finish (why the model stopped) and the
    output, "failed"."""
    return verdict_udf(key)(output, F.lit(None).cast("string") if finish is None else finish)


def _bare(code: Column) -> Column:
    return T.folded(F.regexp_replace(F.coalesce(code, F.lit("")), NAMED, "$1 _NAME_"))


def marked_block(code: Column) -> Column:
    """What stands between the first pair of block marks, trimmed; null without a first mark."""
    mark = lambda which: lambda line: line.rlike(rf"^\s*(?:#|//|--)?\s*EVOLVE-BLOCK-{which}\b")
    first = lambda rows, which: F.get(F.filter(F.transform(rows, lambda x, i: F.when(mark(which)(x), i)), lambda i: i.isNotNull()), F.lit(0))

    def cut(rows: Column) -> Column:
        head = F.slice(rows, F.lit(1), F.coalesce(first(rows, "END"), F.size(rows)))
        inside = lambda h: F.slice(h, first(h, "START") + 2, F.size(h))
        return F.when(first(head, "START").isNotNull(), T.stripped(F.array_join(F.filter(inside(head), lambda x: ~mark("START")(x)), "\n")))

    return F.get(F.transform(F.array(T.lines(code)), cut), F.lit(0))


def change_stats(pairs: DataFrame, keys: list[str], parent: str, child: str, marked: bool = False) -> DataFrame:
    """keys and, of each pair of texts, ok, reason, parent_has_block, child_has_block, parent_chars, child_chars, parent_tokens,
    child_tokens, token_jaccard (of the multisets; 1 without tokens), added, removed, length_ratio (of tokens) and
    sequence_ratio; names of declarations do not count. marked: only the marked blocks are compared, and
    where either text has none, ok is false, reason "missing_evolve_block" and the figures are null. Tokens are
    counted by Spark, a pair's tokens being partial aggregates."""
    sides = [marked_block(F.col(c)) if marked else F.coalesce(F.col(c), F.lit("")) for c in (parent, child)]
    given = pairs.select(*keys, *[c.alias(n) for c, n in zip(sides, ("_p", "_c"))])
    bare = given.select(*keys, F.col("_p").isNotNull().alias("parent_has_block"), F.col("_c").isNotNull().alias("child_has_block"), _bare(F.col("_p")).alias("_a"), _bare(F.col("_c")).alias("_b"))
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    both = F.concat(*[_sided(tokens(c), k) for c, k in (("_a", 0), ("_b", 1))])
    each = bare.select(*keys, F.explode(both).alias("x")).groupBy(*keys, "x.t").agg(F.sum(1 - F.col("x.k")).alias("a"), F.sum("x.k").alias("b"))
    total = lambda c: F.sum(c).cast("long")
    counts = each.groupBy(*keys).agg(total(F.col("a")).alias("parent_tokens"), total(F.col("b")).alias("child_tokens"), total(F.least("a", "b")).alias("_both"))
    rows = bare.select(*keys, "parent_has_block", "child_has_block", F.length("_a").cast("long").alias("parent_chars"), F.length("_b").cast("long").alias("child_chars"), ratio_udf(F.col("_a"), F.col("_b")).alias("sequence_ratio"))
    rows = rows.join(counts, keys, "left").fillna(0, ["parent_tokens", "child_tokens", "_both"])
    ok, either = F.col("parent_has_block") & F.col("child_has_block"), F.col("parent_tokens") + F.col("child_tokens") - F.col("_both")
    figures = {
        "parent_chars": F.col("parent_chars"), "child_chars": F.col("child_chars"), "parent_tokens": F.col("parent_tokens"), "child_tokens": F.col("child_tokens"),
        "token_jaccard": F.when(either > 0, F.col("_both") / either).otherwise(1.0), "added": F.col("child_tokens") - F.col("_both"), "removed": F.col("parent_tokens") - F.col("_both"),
        "length_ratio": F.col("child_tokens") / F.greatest("parent_tokens", F.lit(1)), "sequence_ratio": F.col("sequence_ratio"),
    }
    return rows.select(*keys, ok.alias("ok"), F.when(~ok, "missing_evolve_block").alias("reason"), "parent_has_block", "child_has_block", *[F.when(ok, c).alias(n) for n, c in figures.items()])


def _sided(tokens: Column, side: int) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("k")))


def canonical(code: Column) -> Column:
    """Trimmed preamble lines and the first theorem with a fixed name, white space folded."""
    whole = T.stripped(F.coalesce(code, F.lit("")))
    at = F.regexp_instr(whole, F.lit(r"(?m)^[ \t]*(?:noncomputable\s+)?theorem\b"))
    head = F.when(at > 0, F.substr(whole, F.lit(1), at - 1)).otherwise("")
    body = F.regexp_replace(T.folded(F.when(at > 0, F.substr(whole, at)).otherwise(whole)), r"^(noncomputable )?theorem\s+[^\s:(]+", "$1theorem __NAME__")
    rows = F.filter(F.transform(T.lines(head), T.stripped), lambda x: x != "")
    return F.array_join(F.concat(rows, F.array(body)), "\n")


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else float(not x and not y) for x, y in zip(a, b)], dtype=float)


def similarity_ratio(a: Column, b: Column) -> Column:
    """Matching share of two codes after canonicalising, 0 to 1; for joined pairs only."""
    return ratio_udf(canonical(a), canonical(b))


def best_block(answer: Column) -> Column:
    """(code, source) of a model answer: the last fenced block with a declaration; without one, the
    last theorem of the plain text (else its last declaration) up to its sorry, under the two
    required imports; null and empty if there is no declaration."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?</think>", "")
    start = rf"(?m){T._START}"
    blocks = lambda fence: F.regexp_extract_all(answer, F.lit(rf"(?s)```{fence}\s*\n(.*?)```"), F.lit(1))
    own, other = blocks("(?:lean4?)"), blocks("")
    last = lambda found: F.get(F.reverse(F.filter(F.transform(found, T.stripped), lambda x: x.rlike(start))), F.lit(0))
    clean = T.without_comments(T.without_markers(text))
    pieces = F.split(clean, rf"(?m)(?=^[ \t]*(?:noncomputable\s+|private\s+|protected\s+)*(?:{T.DECLARATIONS})\b)")
    plain = F.coalesce(F.get(F.reverse(F.filter(pieces, lambda x: x.rlike(r"^\s*(?:noncomputable\s+)?theorem\b"))), F.lit(0)), F.get(F.reverse(F.filter(pieces, lambda x: x.rlike(start))), F.lit(0)))
    cut = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in (r"(?s)^(.*?:=\s*by\s*sorry\b)", r"(?s)^(.*?\bby\s+sorry\b)", r"(?s)^(.*\bsorry\b)")], plain)
    opens = F.array_distinct(F.filter(F.transform(T.lines(clean), T.stripped), lambda x: x.rlike(r"^(open|set_option|universe|variable|namespace|section)\b")))
    built = F.array_join(F.concat(F.array(F.lit("import Mathlib"), F.lit("import Aesop")), opens, F.array(F.lit(""), T.stripped(cut))), "\n")
    code = F.coalesce(F.when(F.size(own) > 0, last(own)).otherwise(last(other)), F.when(plain.isNotNull(), built))
    source = F.when(code.isNull(), "").when(F.when(F.size(own) > 0, last(own)).isNotNull(), "lean_fence").when(F.when(F.size(own) == 0, last(other)).isNotNull(), "fence").otherwise("no_fence")
    return F.struct(code.alias("code"), source.alias("source"))


_CHANGE = StructType([StructField("ok", BooleanType()), *[StructField(n, LongType()) for n in ("parent_tokens", "child_tokens", "added", "removed")], StructField("token_jaccard", DoubleType())])
_MARK = re.compile(r"\s*(?:#|//|--)?\s*EVOLVE-BLOCK-(START|END)\b")


def _block_tokens(code: str | None) -> Counter | None:
    """The tokens of a text's first marked block."""
    marks = [(k, m[1]) for k, line in enumerate((code or "").splitlines()) if (m := _MARK.match(line))]
    ends = [k for k, which in marks if which == "END"] or [None]
    begins = [k for k, which in marks if which == "START" and (ends[0] is None or k < ends[0])]
    if not begins:
        return None
    body = "\n".join(line for k, line in enumerate(code.splitlines()[: ends[0]]) if k > begins[0] and k not in begins)
    return Counter(re.findall(TOKEN, re.sub(NAMED, r"\1 _NAME_", body)))


def marked_change_udf():
    """Counts of change between the marked blocks of two texts; ok is false where either has none."""

    def batch(parent: pd.Series, child: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(parent.map(_block_tokens), child.map(_block_tokens)):
            if a is None or b is None:
                rows.append((False, None, None, None, None, None))
            else:
                either = (a | b).total()
                rows.append((True, a.total(), b.total(), (b - a).total(), (a - b).total(), (a & b).total() / either if either else 1.0))
        return pd.DataFrame(rows, columns=_CHANGE.names).astype({n: "Int64" for n in _CHANGE.names[1:5]})

    return F.pandas_udf(batch, _CHANGE)

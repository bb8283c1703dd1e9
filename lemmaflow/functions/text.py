"""Text functions over candidate source code, Column -> Column, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that begin a declaration, and those of statements to prove.
DECLARATIONS = "theorem|lemma|def|abbrev|example|instance|structure|class|inductive|axiom|opaque"
_START = rf"^\s*(?:@\[[^\]]*\]\s*)?(?:noncomputable\s+|private\s+|protected\s+)*(?:{DECLARATIONS})\b"
_NAMED = rf"^(\s*(?:@\[[^\]]*\]\s*)?(?:noncomputable\s+|private\s+|protected\s+)*(?:{DECLARATIONS})\s+)([^\s:({{\[]+)"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


#: White space within a line.
_SPACE = r"[^\S\n]"
#: How a line begins that begins a declaration.
_STARTING = rf"{_SPACE}*(?:@\[[^\]\n]*\]{_SPACE}*)?(?:(?:noncomputable|private|protected){_SPACE}+)*(?:{DECLARATIONS})\b"


def _without_lines(text: Column, line: str) -> Column:
    """Without the lines that the pattern, which stays in one line, fits whole. The text is named once, so
    that functions of functions do not multiply it in a plan."""
    return F.substring(F.regexp_replace(F.concat(F.lit("\n"), text), rf"\n{line}(?=\n|\z)", ""), 2, 2**31 - 1)


def without_markers(text: Column) -> Column:
    """Without the lines that mark what may be edited."""
    return _without_lines(text, r"[^\n]*EVOLVE-BLOCK-(?:START|END)[^\n]*")


def without_header(text: Column) -> Column:
    """Without import and open lines."""
    return _without_lines(text, rf"{_SPACE}*(?:import|open|set_option|universe)\b[^\n]*")


def without_comments(text: Column, mode: str = "inline") -> Column:
    """Without block comments and line comments: inline cuts each line at its first "--"; line_start
    drops lines that begin with it; any removes it to the line's end wherever it stands."""
    text = F.regexp_replace(text, r"(?s)/-.*?-/", "")
    if mode == "line_start":
        return _without_lines(text, rf"{_SPACE}*--[^\n]*")
    if mode == "any":
        return F.regexp_replace(text, r"(?m)--.*$", "")
    return F.regexp_replace(text, r"--[^\n]*", "")


def first_declaration(text: Column) -> Column:
    """From the first line that begins a declaration to the line before the next one; empty if none,
    null for a null text."""
    whole = rf"(?s)\n({_STARTING}.*?)(?=\n{_STARTING}|\z)"
    return F.trim(F.regexp_extract(F.concat(F.lit("\n"), text), whole, 1))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature(code: Column) -> Column:
    """The first declaration up to its first ":=", its name blanked, white space folded."""
    own = first_declaration(without_header(without_comments(code)))
    blank = F.regexp_replace(own, _NAMED, "$1_")
    return folded(F.substring_index(blank, ":=", 1))


#: Keywords at which the key of exact duplicates sees a declaration, and those whose name it blanks.
_KEYED = "theorem|lemma|example|def|definition|abbrev|opaque|axiom|instance|structure|class|inductive"
_KEYED_NAMES = "theorem|def|definition|example|axiom|abbrev|instance"


def exact_text(code: Column) -> Column:
    """What exact duplicates share: the lines before the first declaration, trimmed and without empty ones, and the declaration with a
    fixed name, lemmas as theorems, without attribute lines, white space folded. Thoughts, fences and markers go first. Empty without
    a declaration, and for a null text."""
    starts = rf"{_SPACE}*(?:noncomputable{_SPACE}+)?(?:{_KEYED})\b"
    raw = stripped(F.regexp_replace(F.coalesce(code, F.lit("")), r"(?s)<think>.*?</think>", ""))

    def unfenced(x: Column) -> Column:
        inside = lambda fence: F.nullif(F.regexp_extract(x, rf"(?s)```{fence}\s*\n(.*?)```", 1), F.lit(""))
        return F.coalesce(inside("(?:lean4?)"), inside(""), x)

    def keyed(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(rf"(?s)\A((?:(?!{starts})[^\n]*\n)*+)({starts}.*?)(?=\n{starts}|\z)"), F.lit(1)), F.regexp_extract(x, rf"(?s)\A((?:(?!{starts})[^\n]*\n)*+)({starts}.*?)(?=\n{starts}|\z)", 2)
        before = stripped(F.regexp_replace(F.regexp_replace(F.coalesce(F.get(parts[0], F.lit(0)), F.lit("")), rf"(?m)^{_SPACE}+|{_SPACE}+$", ""), r"\n+", "\n"))
        own = folded(F.regexp_replace(parts[1], r"(?m)^\s*@\[.*\]\s*\n?", ""))
        own = F.regexp_replace(F.regexp_replace(own, r"^(noncomputable )?lemma\b", "$1theorem"), rf"^(noncomputable )?({_KEYED_NAMES}) [^\s:(]+", "$1$2 __NAME__")
        return F.when(own == "", "").when(before == "", own).otherwise(F.concat(before, F.lit("\n"), own))

    clean = F.transform(F.transform(F.array(raw), unfenced), lambda x: stripped(without_markers(x)))
    return F.get(F.transform(clean, keyed), F.lit(0))


def exact_key(code: Column) -> Column:
    """Key for exact duplicates: a hash of exact_text."""
    return F.sha2(exact_text(code), 256)


def force_by_sorry(text: Column) -> Column:
    """The statement with ":= by sorry" instead of its proof; added where there is none."""
    return F.concat(F.regexp_replace(F.substring_index(text, ":=", 1), r"\s+$", ""), F.lit(" := by sorry"))


def skeleton(statement: Column) -> Column:
    """Chunks of a statement that a proof has to keep: the parts between blank lines."""
    parts = F.transform(F.split(statement, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*:=\s*(by\s+)?sorry\s*$", "")))
    return F.filter(parts, lambda x: x != "")


def keeps_skeleton(code: Column, chunks: Column) -> Column:
    return F.forall(chunks, lambda c: F.contains(code, c))


def attempt_parts(attempt_id: Column) -> Column:
    """(group, method, k, g) of ids such as group__method__k03_g12; missing parts are null."""
    base = F.regexp_replace(attempt_id, r"_g\d+$", "")
    parts = F.split(base, "__")
    number = lambda found: F.when(found != "", found.cast("int"))
    k = F.filter(F.slice(parts, 3, 1000), lambda x: x.rlike(r"^k\d+$"))
    return F.struct(
        F.get(parts, F.lit(0)).alias("group"),
        F.get(parts, F.lit(1)).alias("method"),
        F.regexp_extract(F.get(k, F.lit(0)), r"^k(\d+)$", 1).cast("int").alias("k"),
        number(F.regexp_extract(attempt_id, r"_g(\d+)$", 1)).alias("g"),
    )


def attempt_id(group: Column, method: Column, k: Column) -> Column:
    two = F.when(k < 100, F.lpad(k.cast("string"), 2, "0")).otherwise(k.cast("string"))
    return F.concat(group.cast("string"), F.lit("__"), method.cast("string"), F.lit("__k"), two)


def complexity(code: Column) -> Column:
    """(loc, comments, decisions, depth): lines with text, comment lines, branching words, and how
    deep brackets nest."""
    rows = F.filter(lines(code), lambda x: F.trim(x) != "")
    notes = F.filter(rows, lambda x: x.rlike(r"^\s*--"))
    decisions = F.regexp_count(code, F.lit(r"\b(if|match|cases|induction|for|while)\b"))
    steps = F.transform(F.regexp_extract_all(code, F.lit(r"[()\[\]{}]"), F.lit(0)), lambda c: F.when(c.isin("(", "[", "{"), 1).otherwise(-1))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])
    return F.struct(F.size(rows).alias("loc"), F.size(notes).alias("comments"), decisions.alias("decisions"), depth.alias("depth"))


_PROVABLE = r"^[ \t]*(?:noncomputable\s+)?(?:theorem|lemma)\b"
#: Declarations that the guard against placeholders looks at.
_GUARDED = r"(?m)^\s*(?:noncomputable\s+)?(?:theorem|lemma|example|def|abbrev|opaque|axiom|instance)\b"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preamble(code: Column) -> Column:
    """The lines before the first declaration, without attribute lines; all lines if there is none."""
    rows = lines(stripped(code))
    marks = F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(_START), i)), lambda i: i.isNotNull())
    head = F.slice(rows, F.lit(1), F.coalesce(F.get(marks, F.lit(0)), F.size(rows)))
    kept = F.array_join(F.filter(head, lambda x: ~x.rlike(r"^\s*@\[")), "\n")
    return F.when(code.isNotNull(), stripped(kept))


def opaque_header(header: Column) -> Column:
    """A header whose "abbrev name : type := sorry" lines are opaque declarations instead, so that
    they do not count as open proofs."""
    return stripped(F.regexp_replace(header, r"(?m)^([ \t]*)abbrev\s+([^\s:]+)\s*:\s*(.+?)\s*:=\s*sorry[ \t]*$", "$1opaque $2 : $3"))


def header_and_theorem(text: Column) -> Column:
    """(header, theorem) of a whole file, cut where its first theorem begins; no theorem: empty."""
    whole = stripped(text)
    at = F.regexp_instr(whole, F.lit(r"(?m)^[ \t]*(?:noncomputable\s+)?theorem\b"))
    header = F.when(at == 0, whole).otherwise(stripped(F.substr(whole, F.lit(1), at - 1)))
    return F.struct(header.alias("header"), F.when(at == 0, F.lit("")).otherwise(stripped(F.substr(whole, at))).alias("theorem"))


def compose_file(header: Column, statement: Column) -> Column:
    """Header, a blank line, statement; the statement alone where there is no header."""
    head, body = stripped(F.coalesce(header, F.lit(""))), stripped(F.coalesce(statement, F.lit("")))
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def theorem_key(problem_id: Column) -> Column:
    """The problem's name without its number: 0000_name -> name."""
    return F.regexp_replace(stripped(F.coalesce(problem_id, F.lit(""))), r"^\d+_", "")


def theorem_blocks(code: Column) -> Column:
    """Parts of a file that begin with a theorem or lemma and end before the next one."""
    parts = F.split(F.coalesce(code, F.lit("")), f"(?m)(?={_PROVABLE})")
    return F.transform(F.filter(parts, lambda x: x.rlike(_PROVABLE)), stripped)


def has_closed_block(code: Column) -> Column:
    """Is there a theorem or lemma whose block has no sorry?"""
    return F.exists(theorem_blocks(code), lambda x: ~F.contains(x, F.lit("sorry")))


def theorem_name(code: Column) -> Column:
    """Name of the first theorem or lemma, null if there is none."""
    return F.nullif(F.regexp_extract(code, r"(?m)^\s*(?:noncomputable\s+)?(?:theorem|lemma)\s+([A-Za-z0-9_']+)", 1), F.lit(""))


def target_is_open(code: Column, name: Column) -> Column:
    """Is the named theorem missing, or is there a sorry from it to the end of the file?"""
    at = F.regexp_instr(code, F.concat(F.lit(r"(?m)^\s*(?:noncomputable\s+)?(?:theorem|lemma)\s+\Q"), name, F.lit(r"\E\b")))
    return F.when(F.coalesce(at, F.lit(0)) == 0, True).otherwise(F.contains(F.substr(code, at), F.lit("sorry")))


def solution_tags(statement: Column) -> Column:
    """Names ending in _solution that a statement's abbrev chunks leave to be filled in."""
    parts = F.transform(F.split(stripped(without_comments(F.coalesce(statement, F.lit("")), "line_start")), "\n\n"), stripped)
    own = F.filter(parts, lambda x: ~x.rlike("^(import|set_option|open)"))
    return F.filter(F.transform(own, lambda x: F.regexp_extract(x, r"(?m)^\s*abbrev\s+([A-Za-z0-9_]+_solution)\b", 1)), lambda x: x != "")


def with_answer_checks(code: Column, statement: Column, answers: Column) -> Column:
    """(ok, reason, code): the code with one equality check for each tag and answer. Without tags or
    answers nothing is checked; unequal numbers and blank answers are errors and leave it as it is."""
    tags = solution_tags(statement)
    known = F.coalesce(answers, F.array().cast("array<string>"))
    blank = F.exists(known, lambda x: F.coalesce(stripped(x), F.lit("")) == "")
    checks = F.array_join(F.transform(F.arrays_zip(tags.alias("t"), known.alias("a")), lambda p: F.concat(F.lit("\n\nexample: "), p["t"], F.lit(" = "), stripped(p["a"]), F.lit(" := by\n  try rfl\n  try norm_num"))), "")
    idle = (F.size(tags) == 0) | (F.size(known) == 0)
    reason = F.when(idle, "").when(F.size(tags) != F.size(known), F.concat(F.lit("arity mismatch: tags="), F.size(tags).cast("string"), F.lit(" answers="), F.size(known).cast("string"))).when(blank, "empty answer").otherwise("")
    return F.struct((reason == "").alias("ok"), reason.alias("reason"), F.when(idle | (reason != ""), code).otherwise(F.concat(code, checks)).alias("code"))


def truncated(message: Column, most: int = 500) -> Column:
    message = F.coalesce(message, F.lit(""))
    return F.when(F.length(message) <= most, message).otherwise(F.concat(F.substring(message, 1, most), F.lit("... [truncated]")))


def redacted(message: Column) -> Column:
    """Without home folders' paths. Fixed value: the characters that end a path, the letter s among them."""
    return F.regexp_replace(F.coalesce(message, F.lit("")), r"/(?:home|Users)/[^\\s:'\"`]+", "[REDACTED_PATH]")


def accuracy_section(reasons: Column) -> Column:
    """What a judge writes after its heading "5. Accuracy Confirmation"; empty without that."""
    return stripped(F.regexp_extract(F.coalesce(reasons, F.lit("")), r"(?is)\b5\s*\.?\s*Accuracy\s*Confirmation\s*:?\s*(.*)\z", 1))


def declaration_type(declaration: Column) -> Column:
    """The type that a declaration states: from its first colon outside brackets to the next := that
    is outside brackets, white space folded; null if there is none."""
    tokens = F.regexp_extract_all(declaration, F.lit(r"[(\[{]|[)\]}]|:=|:|[^()\[\]{}:]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("phase"), F.lit("").alias("text"))

    def step(a, t):
        depth = F.when(t.isin("(", "[", "{"), a["depth"] + 1).when(t.isin(")", "]", "}"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        outside = a["depth"] == 0
        phase = F.when((a["phase"] == 0) & (t == ":") & outside, 1).when((a["phase"] == 1) & (t == ":=") & outside, 2).otherwise(a["phase"])
        text = F.when((a["phase"] == 1) & (phase == 1), F.concat(a["text"], t)).otherwise(a["text"])
        return F.struct(depth.alias("depth"), phase.alias("phase"), text.alias("text"))

    return F.nullif(folded(F.aggregate(tokens, start, step, lambda a: a["text"])), F.lit(""))


def is_trivial(code: Column, level: int = 1) -> Column:
    """Does the first declaration state something empty? Level 0: never; 1: True; 2: also what ends
    in True after an arrow or a quantifier, or follows from False; 3: also x = x."""
    if level <= 0:
        return F.lit(False)
    clean = without_comments(_without_lines(without_markers(code), rf"{_SPACE}*(?:import|open)\b[^\n]*"), "any")
    at = F.regexp_instr(clean, F.lit(_GUARDED))
    own = declaration_type(F.when(at > 0, stripped(F.substr(clean, at))))
    found = own == "True"
    if level >= 2:
        found = found | own.rlike(r"(?:→|->)\s*True$") | own.rlike(r"^(?:∀|forall)\s+.*,\s*True$") | own.rlike(r"^False\s*(?:→|->)\s*")
    if level >= 3:
        found = found | own.rlike(r"^\(?\s*([A-Za-z_][A-Za-z0-9_']*)\s*\)?\s*=\s*\(?\s*\1\s*\)?$")
    return F.coalesce(found, F.lit(False))


def import_prefix(code: Column) -> Column:
    """Reason why a file does not begin with its two required imports; empty if it does."""
    rows = F.filter(F.transform(lines(code), stripped), lambda x: (x != "") & ~x.rlike("EVOLVE-BLOCK-(START|END)"))
    good = (F.get(rows, F.lit(0)) == "import Mathlib") & (F.get(rows, F.lit(1)) == "import Aesop")
    return F.when(F.coalesce(good, F.lit(False)), "").otherwise("missing_required_import_lines")


def merged_proof(statement: Column, proof: Column) -> Column:
    """The statement up to its ":= by" with the proof's body below, the indentation of the body's
    first line taken from every line; empty where either part is missing."""
    head = F.regexp_extract(statement, r"(?is)^(.*?:=\s*by\b)", 1)
    own = stripped(proof)
    whole = own.rlike(r"(?is):=\s*by\b")
    body = F.when(whole, F.regexp_replace(own, r"(?is)^.*?:=\s*by\b", "")).otherwise(F.regexp_replace(own, r"^\s*by\b", ""))
    indent = F.regexp_extract(body, r"(?s)^(?:[ \t]*\n)*([ \t]*)\S", 1)
    rows = F.transform(lines(body), lambda x: F.when(F.startswith(x, indent), F.substr(x, F.length(indent) + 1)).otherwise(x))
    text = F.concat(stripped(head), F.lit("\n"), F.regexp_replace(F.array_join(rows, "\n"), r"^\n+", ""))
    usable = (head != "") & (F.coalesce(own, F.lit("")) != "")
    return F.when(F.coalesce(usable, F.lit(False)), F.concat(stripped(text), F.lit("\n"))).otherwise("")


def normal_code(text: Column) -> Column:
    """Model output without its thoughts; the first fenced block if there is one."""
    clean = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""))
    own = F.regexp_extract(clean, r"(?s)```(?:lean4?)\s*\n(.*?)```", 1)
    other = F.regexp_extract(clean, r"(?s)```\s*\n(.*?)```", 1)
    return stripped(F.when(own != "", own).when(other != "", other).otherwise(clean))


def fenced_proof(text: Column) -> Column:
    """The last fenced block of a prover's answer; of one never closed, what follows its opening;
    without a fence, the text from its first declaration on; else empty."""
    blocks = F.coalesce(*[F.nullif(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?s)```{kind}\n(.*?)```"), F.lit(1)), F.lit(-1)), F.lit("")) for kind in ("lean4", "lean")])
    opened = F.nullif(F.regexp_extract(text, r"(?s)```lean4?\n(.*)\z", 1), F.lit(""))
    at = F.regexp_instr(text, F.lit(r"(?m)^\s*(?:import|set_option|open|abbrev|opaque|axiom|instance|(?:noncomputable\s+)?(?:theorem|lemma|def|example))\b"))
    return stripped(F.coalesce(blocks, opened, F.when(at > 0, F.substr(text, at)), F.lit("")))


#: Answers that stand for no result.
NO_RESULT = ("none", "null", "nil", "n/a", "na", "")


def statement_of(text: Column) -> Column:
    """The first declaration of a text without comments, header and marker lines; a theorem or lemma
    comes before other declarations. Empty where the text, or what is left, stands for no result."""
    clean = without_markers(without_header(without_comments(F.coalesce(text, F.lit("")))))
    at = F.regexp_instr(clean, F.lit(r"(?m)^\s*(?:@\[[^\]]*\]\s*)?(?:noncomputable\s+|private\s+|protected\s+)*(?:theorem|lemma)\b"))
    own = first_declaration(F.when(at > 0, F.substr(clean, at)).otherwise(clean))
    blank = lambda c: F.lower(stripped(c)).isin(*NO_RESULT)
    return F.when(blank(F.coalesce(text, F.lit(""))) | blank(own), F.lit("")).otherwise(own)


def renamed(statement: Column, name: str) -> Column:
    """(statement, name): the statement with its declaration's name replaced, and the name it had."""
    had = F.nullif(F.regexp_extract(statement, _NAMED, 2), F.lit(""))
    return F.struct(F.regexp_replace(statement, _NAMED, f"$1{name}").alias("statement"), had.alias("name"))


def unnamed(statement: Column) -> Column:
    """The statement without its keyword and name, as a prompt shows it."""
    return stripped(F.regexp_replace(statement, rf"^\s*(?:@\[[^\]]*\]\s*)?(?:noncomputable\s+|private\s+|protected\s+)*(?:{DECLARATIONS})\s+[^\s:({{\[]+", ""))


def canonical_statement(code: Column, name: str = "X") -> Column:
    """The statement under a fixed name, without white space at the ends of its lines: the key by which
    statements are counted once."""
    own = renamed(statement_of(code), name)["statement"]
    return stripped(F.array_join(F.transform(lines(own), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"))


def precheck(code: Column, statement: Column, forbidden: list[str]) -> Column:
    """(ok, reason) of a proof before it is compiled: not empty without comments, none of the forbidden
    words, and every chunk of the statement still there (sorry not counting; headers left out)."""
    out = stripped(without_comments(F.coalesce(code, F.lit("")), "line_start"))
    wanted = stripped(without_comments(F.coalesce(statement, F.lit("")), "line_start"))
    split = F.split(F.regexp_replace(wanted, r"\n(?=(?:noncomputable )?theorem)", "\n\n"), r"\n\n")
    chunks = F.filter(F.transform(F.filter(F.transform(split, stripped), lambda x: ~x.rlike("^(import|set_option|open)")), lambda x: stripped(F.regexp_replace(x, r"\bsorry\b", ""))), lambda x: x != "")
    missing = F.size(F.filter(chunks, lambda x: ~F.contains(out, x)))
    words = F.array(*[F.lit(w) for w in forbidden if w]) if any(forbidden) else F.array().cast("array<string>")
    found = F.get(F.filter(words, lambda w: F.contains(out, w)), F.lit(0))
    reason = F.when(out == "", "empty").when(found.isNotNull(), F.concat(F.lit("forbidden: "), found)).when(missing > 0, F.concat(F.lit("missing chunks: "), missing.cast("string"))).otherwise("")
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))

"""Quality rules with thresholds that follow the data.

Each language and source has its own limits, from quantile sketches of its documents' statistics.
The sketches merge by aggregation, so a group of any size is summed up before it is shuffled. A
group's own sketch is merged with its language's and that of all documents, whose weight falls as the
group grows: so groups of every size are treated alike, small ones leaning on their parents. The
limits are joined back and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import durable, join_spread

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8

STATISTICS = ("word_length", "symbol_share", "dup_line_share", "repeat_share")
#: Statistics for which too small is bad, too.
TWO_SIDED = ("word_length",)


def _code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words stand in a window of `size` (a power of two) words that is found twice or more."""
    n = len(words)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if n <= size or len(numbers) == n:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(0xD1342543DE82EF95) + mixed[k : n - size + 1 + k]
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0  # no equal hashes, no equal windows
    names, width = ids, 1
    while width < size:  # exact: equal names, equal windows of that width
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        names, width = np.unique(pairs, return_inverse=True)[1], 2 * width
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[:-size] += twice
    edges[size:] -= twice
    return int(np.count_nonzero(np.cumsum(edges)))


def text_statistics(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, lines with a word, of them those that equal an earlier
    line, words in repeated windows) of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    packed = text.translate(None, BLANKS)
    return len(words), _code_points(packed), len(packed) - len(packed.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words),
    one row for every row of docs; a null text has none of anything."""
    from lemmaflow.llm.quality import text_statistics as count

    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [count(t or b"") for t in b.column(3).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["doc_id", "lang", "source", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _measures() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"word_length": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words}


#: Points at which a sketch is read when it is merged with its parents' sketches.
GRID = 200


def _merged(parts: list[tuple[Column, Column]], at: float) -> Column:
    """The quantile `at` of several sketches (values at GRID points, ascending; weight) put together:
    the smallest value up to which that share of the weight lies."""
    def weighed(values: Column, weight: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<double>")), lambda x: F.struct(x.alias("x"), weight.cast("double").alias("w")))

    points = F.concat(*[weighed(*part) for part in parts])
    total = sum((F.coalesce(F.array_size(values), F.lit(0)) * weight for values, weight in parts), F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("x"))
    step = lambda a, p: F.struct((a["w"] + p["w"]).alias("w"), F.when(a["x"].isNull() & (a["w"] + p["w"] >= at * total - 1e-9), p["x"]).otherwise(a["x"]).alias("x"))
    return F.aggregate(F.array_sort(points), start, step, lambda a: a["x"])


def _group(*names: str) -> Column:
    """One text for the values of some columns, null being a value like any other."""
    return F.concat(*[F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), n), F.lit("-")) for n in names])


def limits(stats: DataFrame, tails: tuple[float, float] = (0.01, 0.97), parent_docs: int = 20, accuracy: int = 1000) -> DataFrame:
    """Limits of every language and source: lang, source, docs (with words), n (all), and for each
    statistic low and high: the quantiles `tails` of the group's own sketch merged with its parents',
    which weigh as m * m / (docs + m) documents, m being parent_docs. That weight is the language's and
    all documents', the latter's share being m / (the language's docs + m). Wordless documents count in
    n only."""
    wordy = F.col("n_words") > 0
    rows = stats.select("lang", "source", *[F.when(wordy, c).alias(n) for n, c in _measures().items()])
    grid = [(i + 0.5) / GRID for i in range(GRID)]
    sketches = [F.percentile_approx(n, grid, accuracy).alias(n) for n in STATISTICS]
    groups = durable(rows.rollup("lang", "source").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count(STATISTICS[0]).alias("docs"), *sketches))
    parent = lambda gid: groups.where(F.col("gid") == gid).select(_group("lang").alias(f"g{gid}"), F.struct("docs", *STATISTICS).alias(f"p{gid}"))
    every = F.broadcast(parent(3).select("p3"))  # one row
    own = groups.where("gid = 0").withColumn("g1", _group("lang")).join(parent(1), "g1").crossJoin(every)
    far = parent_docs / (F.col("p1.docs") + parent_docs)
    lean = parent_docs * parent_docs / (F.col("docs") + parent_docs) / GRID
    out = ["lang", "source", "docs", "n"]
    for n in STATISTICS:
        parts = [(F.col(n), F.col("docs") / GRID), (F.col(f"p1.{n}"), lean * (1 - far)), (F.col(f"p3.{n}"), lean * far)]
        low = _merged(parts, tails[0]) if n in TWO_SIDED else F.lit(float("-inf"))
        out += [low.alias(f"{n}_low"), _merged(parts, tails[1]).alias(f"{n}_high")]
    return own.select(*out)


def quality_verdicts(docs: DataFrame, tails: tuple[float, float] = (0.01, 0.97), parent_docs: int = 20, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row for every row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, group_docs (documents with words in its language and source).

    base_failed: fewer than min_words words, or over max_repeat_percent of the words in repeated
    8-word windows. kept: not base_failed, and all statistics within the limits of the document's
    language and source. Null languages and sources are groups like any other. Null text: no words,
    base_failed.
    """
    return _verdicts(docs, tails, parent_docs, min_words, max_repeat_percent).drop("lang", "source")


def rejections(docs: DataFrame, **rules) -> DataFrame:
    """(lang, source, docs, base_failed, limited): of each group how many documents the base rules
    reject, and how many more the limits do."""
    count = lambda c: F.sum(c.cast("long"))
    rows = _verdicts(docs, **rules).groupBy("lang", "source")
    return rows.agg(F.count("*").alias("docs"), count(F.col("base_failed")).alias("base_failed"), count(~F.col("base_failed") & ~F.col("kept")).alias("limited"))


def _verdicts(docs: DataFrame, tails: tuple[float, float] = (0.01, 0.97), parent_docs: int = 20, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    stats = durable(statistics(docs))
    bounds = durable(limits(stats, tails, parent_docs).withColumn("group", _group("lang", "source")).drop("lang", "source"))
    rows = join_spread(stats.withColumn("group", _group("lang", "source")), bounds, "group")
    within = F.lit(True)
    for n, c in _measures().items():
        within = within & F.coalesce(c.between(F.col(f"{n}_low"), F.col(f"{n}_high")), F.lit(True))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.select(
        "lang", "source", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"), F.col("docs").alias("group_docs"),
    )

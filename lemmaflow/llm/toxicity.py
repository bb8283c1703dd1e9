"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams it has, hashed. Each counts as its log-count ratio
between toxic and other training texts, and a logistic regression learns a weight for it. Labels,
language, source and id never enter a score.

Training uses a bounded sample of labelled texts (SAMPLE, a parameter): the ones with the smallest
hash of their id. Sample and model are of fixed size, so they may pass the driver; counting and
scoring run in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import back, durable, rest_of, slices

#: Labelled texts that training uses at most.
SAMPLE = 12_000
#: Hash buckets of n-grams, and how many of them, at most, the model keeps.
BUCKETS = 1 << 20
FEATURES = 10_000
SIZES = (3, 4, 5)
_SLICE = 1 << 20


def grams(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text in lower case with a blank at either end, white space runs
    being one blank; long texts in overlapping slices."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), _SLICE):
        chars = np.frombuffer(text[at : at + _SLICE + max(sizes) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = chars
        for n in range(2, max(sizes) + 1):
            if len(chars) < n:
                break
            h = h[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
            if n in sizes:
                x = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                yield ((x ^ (x >> np.uint64(32))) >> np.uint64(8)).astype(np.int64) & (BUCKETS - 1)


def features(text: str, keep: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text for which keep (a bool for each bucket) is true."""
    found = [b[keep[b]] for b in grams(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `sample` labelled ids that are not held out. Labels that are null or
    without an id count for nothing; an id with several labels is toxic if any says so."""
    known = labels.where("doc_id is not null and toxic is not null").where(~_held_out())
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(durable(some)), "doc_id")  # `sample` rows at most
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def fit(columns: np.ndarray, lengths: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float = 10.0, steps: int = 300, rate: float = 0.1, part: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows, columns scaled by `scale`; returns the weights of the
    unscaled columns and the intercept. columns: the rows' column numbers, one row after the other;
    lengths: how many each row has. Adam on the whole sample, gone through in parts of about `part`
    numbers, so that little more than the sample itself is held. Both classes weigh the same in all,
    so that rare toxic texts are not simply outvoted; a score of 0.5 is where a text is as likely to
    come from either class."""
    share = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    ends = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(columns) + part, part)))
    cuts = np.unique([0, *cuts, len(y)])
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        ws, total, slope = w * scale, 0.0, np.zeros(len(scale))
        for low, high in zip(cuts, cuts[1:]):
            own = columns[ends[low] - lengths[low] : ends[high - 1]]
            at = np.repeat(np.arange(high - low), lengths[low:high])
            z = np.bincount(at, ws[own], high - low) + b
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[low:high]) * share[low:high]
            slope += np.bincount(own, error[at], len(scale))
            total += error.sum()
        g = np.append((slope * scale + l2 * w) / len(y), total / len(y))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (1 - t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * scale, float(b)


class ToxicityModel:
    """Weights for at most FEATURES buckets, and an intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights.astype(np.float32), intercept

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = FEATURES) -> ToxicityModel:
        from lemmaflow.llm.toxicity import BUCKETS as buckets
        from lemmaflow.llm.toxicity import features as of

        rows = durable(training_rows(docs, labels, sample))
        n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
        toxic, other = n.get(1, 0), n.get(0, 0)
        if not toxic or not other:
            rate = toxic / (toxic + other) if toxic + other else 0.0
            return cls(np.empty(0, np.int64), np.empty(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, every = np.zeros((2, buckets), dtype=np.int64), np.ones(buckets, dtype=bool)
            for b in slices(batches):
                for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seen[int(y > 0), of(text, every)] += 1
            some = np.nonzero(seen.any(axis=0))[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1, some]), pa.array(seen[0, some])], ["bucket", "yes", "no"])

        counts = rows.mapInArrow(count, "bucket long, yes long, no long").groupBy("bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        ratio = F.log((F.col("yes") + 1) / (toxic + 2)) - F.log((F.col("no") + 1) / (other + 2))
        weight = F.abs(ratio) * F.sqrt(F.col("yes") + F.col("no") * (toxic / other))  # far ratios of which one can be sure
        best = counts.where("yes + no >= 5").select("bucket", ratio.alias("ratio"), weight.alias("weight")).orderBy(F.desc("weight"), "bucket").limit(size)
        chosen = sorted((r["bucket"], r["ratio"]) for r in best.collect())  # `size` rows at most
        own = np.array([b for b, _ in chosen], dtype=np.int64)
        ratios = np.array([r for _, r in chosen])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = np.zeros(buckets, dtype=bool)
            keep[own] = True
            for b in slices(batches):
                found = [np.searchsorted(own, of(t, keep)).astype(np.int32) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "columns"])

        table = rows.mapInArrow(encode, "toxic int, columns array<int>").toArrow()  # `sample` rows at most
        found = table.column("columns").combine_chunks()
        lengths = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        weights, intercept = fit(found.flatten().to_numpy(), lengths, (table.column("toxic").to_numpy() > 0).astype(float), ratios)
        return cls(own, weights, intercept)

    def score(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """The named columns of docs and score, 0 to 1, for every row; null texts count as empty."""
        from lemmaflow.llm.toxicity import BUCKETS as buckets
        from lemmaflow.llm.toxicity import features as of

        own, weights, intercept = self.buckets, self.weights, self.intercept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep, value = np.zeros(buckets, dtype=bool), np.zeros(buckets, dtype=np.float32)
            keep[own], value[own] = True, weights
            for b in slices(batches):
                z = np.array([intercept + float(value[of(t or "", keep)].sum(dtype=np.float64)) for t in b.column("text").to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

        schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("score", "double")
        return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])]).mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, repeated rows and null ids too
    (a null id is not held out). Null and empty texts get the score of a text without features.
    Without labels of both kinds every score is the share of toxic ones."""
    model = ToxicityModel.train(docs, labels, sample)
    rows = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return rows.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score threshold or more; columns, whatever their names, stay as
    they are. Null and empty texts get the score of a text without features."""
    model = ToxicityModel.train(docs, labels, sample)
    rows = model.score(docs.select(rest_of(docs, "text"), "text"), ["row", "text"])
    return rows.where(F.col("score") < threshold).select(*back(docs, text=F.col("text")))

"""Bounded archives of programs as keyed state, the same fold for batch and stream, and running
aggregates over a stream of results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "run_id long, id long, score double, seq long"


def archive_fold(kept: list[tuple], row: tuple, size: int) -> list[tuple]:
    """kept: (score, seq, key, id) of at most `size` members. A correct newcomer whose key is new
    fills a free place; in a full archive it replaces the worst, the oldest among equals, if it is at
    least as good."""
    score, seq, key, ident = row
    if any(k[2] == key for k in kept):
        return kept
    if len(kept) < size:
        return [*kept, row]
    worst = min(kept, key=lambda k: (k[0], k[1]))
    return [k for k in kept if k is not worst] + [row] if score >= worst[0] else kept


def batch_archive(rows: DataFrame, size: int) -> DataFrame:
    """Replays rows (run_id, id, seq, key, score, correct) in the order of seq and id, and returns each
    run's archive. Rows without a seq come last; those without a score are left out. Spark sorts, with
    spill, only the columns that the fold needs; a task holds a batch of rows and at most `size` members,
    however long a run is. A run's replay is sequential by nature: its rows go through one task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, kept, begun = None, [], False

        def members() -> pa.RecordBatch:
            found = [(run, k[3], k[0], None if k[1] == math.inf else k[1]) for k in kept]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["run_id", "id", "score", "seq"])

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("run_id", "id", "seq", "key", "score")]):
                if begun and r[0] != run:
                    yield members()
                    kept = []
                run, begun = r[0], True
                kept = archive_fold(kept, (r[4], math.inf if r[2] is None else r[2], r[3], r[1]), size)
        if begun:
            yield members()

    types = {"run_id": "long", "id": "long", "seq": "long", "key": "string", "score": "double"}
    need = rows.where("correct = 1 and score is not null").select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    in_order = need.repartition("run_id").sortWithinPartitions("run_id", F.col("seq").asc_nulls_last(), "id")
    return in_order.mapInArrow(fold, RESULT)


def stream_archive(stream: DataFrame, size: int) -> DataFrame:
    """The same over a stream: one state for each run of at most `size` members; each batch emits
    the archive of the runs it touched. Rows of a batch are folded in the order of seq and id; those
    without a score are left out."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["seq", "id"])
        for r in rows.itertuples(index=False):
            kept = archive_fold(kept, (r.score, r.seq, r.key, r.id), size)
        state.update(tuple(list(x) for x in zip(*kept)))
        yield pd.DataFrame([(key[0], k[3], k[0], k[1]) for k in kept], columns=["run_id", "id", "score", "seq"])

    state = "scores array<double>, seqs array<long>, keys array<string>, ids array<long>"
    need = stream.where("correct = 1 and score is not null").select("run_id", "id", "seq", "key", "score")
    return need.groupBy("run_id").applyInPandasWithState(fold, RESULT, state, "update", "NoTimeout")


def running_best(stream: DataFrame) -> DataFrame:
    """Best program of each run so far; for update or complete mode."""
    return stream.groupBy("run_id").agg(F.max_by("id", F.struct("score", -F.col("seq"))).alias("best_id"), F.max("score").alias("best_score"))


def failure_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("error_type").agg(F.count("*").alias("failures"), F.sum("repair_attempts").alias("repair_attempts"))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest record of each key: the merge of result files that a foreachBatch upsert does."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("_r")).select(key, "_r.*")

"""Streams of results: bounded text archives, newest-record merges, gaps of finished tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.operators.attempts import missing_samples

KEPT = "run_id long, text string, reward double, seq long"


def _add(kept: list[tuple], row: tuple, size: int) -> list[tuple]:
    """kept: (reward, seq, text), best first. A text that is there stays as it is."""
    if any(k[2] == row[2] for k in kept):
        return kept
    return sorted([*kept, row], key=lambda k: (-k[0], k[1]))[:size]


def text_archive(stream: DataFrame, size: int) -> DataFrame:
    """Each run's `size` best different texts so far, of a stream (run_id, seq, text, reward). A text
    that was cut may come in again, so this is a state, not a dropDuplicates."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            kept = _add(kept, (r.reward, r.seq, r.text), size)
        state.update(tuple(list(x) for x in zip(*kept)))
        yield pd.DataFrame([(key[0], k[2], k[0], k[1]) for k in kept], columns=["run_id", "text", "reward", "seq"])

    return stream.select("run_id", "seq", "text", "reward").groupBy("run_id").applyInPandasWithState(fold, KEPT, "rewards array<double>, seqs array<long>, texts array<string>", "update", "NoTimeout")


def batch_text_archive(rows: DataFrame, size: int) -> DataFrame:
    """The same of a whole table, for rewards that follow from the text: then a text that was cut never
    comes in again, and the first row of each text decides; ties go to the earlier row."""
    best = rows.groupBy("run_id", "text").agg(F.min(F.struct("seq", "reward")).alias("b")).select("run_id", "text", "b.reward", "b.seq")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("reward"), "seq"))
    return best.withColumn("_k", rank).where(F.col("_k") <= size).drop("_k")


def upsert_newest(path: str, key: str, order: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest record of each key in Parquet, in folders by a hash
    of the key. Only the folders that a batch touches are read and written again; each goes to a new
    version, named by batch, so a batch that is run twice does no harm. latest() reads the result."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = latest(spark, path, new.schema, before=number).join(new.select("bucket").distinct(), "bucket", "left_semi")
        other = [c for c in new.columns if c not in (key, "bucket")]
        merged = old.unionByName(new).groupBy("bucket", key).agg(F.max_by(F.struct(*other), order).alias("r")).select("bucket", key, "r.*")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number:010d}")

    return merge


def latest(spark, path: str, schema, before: int | None = None) -> DataFrame:
    """The newest version of every bucket (before that of a batch)."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    names = [c for c in schema.names if c != "bucket"]
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "bucket") + ", version long, bucket int").option("basePath", path).parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"], "left_semi").select(*names, "bucket")


def drop_superseded(spark, path: str, before: int) -> int:
    """Removes the bucket folders of versions under `before` that a newer version, itself under `before`, has replaced, and returns
    how many. Batches from `before` on may still run again, so what they read stays. latest() gives the same rows as before it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return 0
    number = lambda name: int(name.rpartition("=")[2])
    folders = [(number(v.getPath().getName()), b.getPath()) for v in system.listStatus(root) if v.getPath().getName().startswith("version=") for b in system.listStatus(v.getPath()) if b.getPath().getName().startswith("bucket=")]
    newest: dict[int, int] = {}
    for version, folder in folders:
        if version < before:
            newest[number(folder.getName())] = max(version, newest.get(number(folder.getName()), -1))
    old = [folder for version, folder in folders if version < newest.get(number(folder.getName()), -1)]
    for folder in old:
        system.delete(folder, True)
    return len(old)


def watch_missing(tasks: DataFrame, emit: Callable[[DataFrame], None], present: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over newly finished tasks (task) that hands their missing samples to
    emit. present() reads which samples there are at that time."""

    def check(batch: DataFrame, _: int) -> None:
        emit(missing_samples(tasks.join(batch.select("task").distinct(), "task", "left_semi"), present()))

    return check

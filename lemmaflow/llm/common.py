"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and words, as every contract here has them.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether Spark deletes a query's shuffles at its end; else they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes after which a batch of rows goes to Python; JVM and Python both hold a batch, for each task.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in only on a local master
    (tests), where there is one machine; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lemmaflow-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def durable(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost
    executor costs no more than the tasks it ran. The files go with forget, or when the driver ends.
    The shuffles that df took go as soon as it is written: only its files are read from then on.
    While it is written, rows go to Python in small batches."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lemmaflow-{uuid.uuid4().hex}"
    own = {_CLEAN: "true", _BATCH: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    system, jvm_path = _files(spark, path)
    system.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that a task makes Python objects of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of durable tables that nothing reads any more."""
    for df in tables:
        system, jvm_path = _files(df.sparkSession, df._durable_path)
        system.delete(jvm_path, True)


def rest_of(docs: DataFrame, *but: str) -> Column:
    """All of docs' columns, but those named, in one struct "row", so that no name of theirs can meet
    one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")


def back(docs: DataFrame, **changed: Column) -> list[Column]:
    """docs' columns out of "row", in their order, the changed ones as given."""
    return [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def free_name(name: str, docs: DataFrame) -> str:
    """name, with as many underscores behind it as it takes to be none of docs' columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _has_map(kind: T.DataType) -> bool:
    """Whether a type is or holds a map, which Spark does not hash."""
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def row_turn(rows: DataFrame, places: Column) -> Column:
    """One of `places` numbers from 0, by a hash of the whole row: a task that runs again, over rows in
    any order, deals each row as before."""
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if not _has_map(f.dataType)]
    return F.pmod(F.xxhash64(F.lit(7), *hashed), places)


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n", total: int | None = None, pieces: int = 10_000) -> DataFrame:
    """rows joined with keyed (one row a key, n: how many of rows have it) on key; n is left out.

    A key that more than 1 / pieces of the rows have is dealt to several places, its row of keyed being
    sent to each, so that no task gets a hot key whole. A hash of the row says which place. At most `pieces` keys can be that frequent:
    only their names and numbers are broadcast. total: the sum of n, counted where it is not given."""
    per = max(1, ((keyed.agg(F.sum(n)).first()[0] if total is None else total) or 0) // pieces)
    deals = F.ceil(F.col(n) / per).cast("int")
    hot = keyed.where(F.col(n) > per).select(key, deals.alias("_deals"))
    turn = F.when(F.col("_deals").isNull(), 0).otherwise(row_turn(rows, F.col("_deals"))).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_deal", turn).drop("_deals")
    places = F.sequence(F.lit(0), F.when(F.col(n) > per, deals - 1).otherwise(0))
    return dealt.join(keyed.withColumn("_deal", F.explode(places)).drop(n), [key, "_deal"]).drop("_deal")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns, key_id and key_text, that name a row by its id and text and are never null.
    Rows with the same id and text have the same key and get the same treatment."""
    return [
        F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("key_id"),
        F.xxhash64(F.lit(1), F.col(text_col)).alias("key_text"),
    ]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for every node that has an edge,
    root being the component's smallest node.

    Alternating large-star and small-star rounds. Minima are partial aggregates and the joins deal a
    node with very many neighbours to several places, so that it is no bottleneck. Rounds are
    logarithmic in the component's diameter. Self-loops, null ends and repeated edges are dropped.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u is not null and v is not null and u > v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    e = durable(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = tidy(join_spread(both.where("v > u"), low, "u", total=2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, "u", total=before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, durable(tidy(small))
        after = state(e)
        forget(old)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(e.select("v", "v").distinct().toDF("node", "root"))

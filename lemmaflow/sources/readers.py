"""Readers and writers of run files: JSON lines, manifests, compile results, logs, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaflow.sources import arrays

PROBLEM = T.StructType([T.StructField(n, T.StringType()) for n in ("problem_name", "full_name", "informal_stmt", "header", "formal_stmt")])


def tolerant_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank and broken lines are skipped. With a key, its first row by place in
    the file stays."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).where(F.trim("value").startswith("{"))
    rows = lines.withColumn("r", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).where("r._corrupt_record is null")
    if key:
        rank = F.row_number().over(Window.partitionBy(f"r.{key}").orderBy("_file", "_at"))
        rows = rows.withColumn("_k", rank).where("_k = 1")
    return rows.select(*[F.col(f"r.{f.name}") for f in schema.fields])


def problems(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Benchmark problems of JSON lines, with defaults for missing fields, and their number (index) over all files by name. first:
    only so many lines are read, blank ones included. A broken line fails the job."""
    rows = arrays.pieces(spark, path)
    if first is not None:
        rows = arrays.numbered(rows, F.lit(True), False).where(F.col("number") < first).drop("number")
    rows = arrays.numbered(rows, F.trim(F.regexp_replace("value", r"\s", "")) != "", False).where(F.regexp_replace("value", r"\s", "") != "")
    rows = rows.select(F.from_json("value", PROBLEM, {"mode": "FAILFAST"}).alias("r"), F.col("number").cast("long").alias("index")).select("r.*", "index")
    or_else = lambda c, value: F.coalesce(F.nullif(F.trim(c), F.lit("")), value)
    rows = rows.withColumn("problem_name", or_else("problem_name", F.format_string("problem_%04d", F.col("index"))))
    return rows.withColumns({"full_name": or_else("full_name", F.col("problem_name")), "informal_stmt": F.coalesce("informal_stmt", F.lit("")), "header": or_else("header", F.lit("import Mathlib"))})


def manifest_runs(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, method, run_dir) of all manifests under a path."""
    schema = "problems array<struct<problem_id string, problem_name string, runs map<string,string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
    return rows.select(F.explode("problems").alias("p")).select("p.problem_id", F.explode("p.runs").alias("method", "run_dir"))


def typed_programs(programs: DataFrame) -> DataFrame:
    """Programs with the usual metrics as columns and the time as a timestamp."""
    m = F.from_json("public_metrics", "compile_ok double, semantic_ok double, beq_ok double, cycle_score double")
    return programs.withColumns({"ts": F.timestamp_seconds("timestamp"), "vector": F.from_json("embedding", "array<float>")}).withColumns({f"metric_{n}": m[n] for n in ("compile_ok", "semantic_ok", "beq_ok", "cycle_score")})


def write_table(rows: DataFrame, path: str, columns: list[str], order: list[str], kind: str = "csv") -> None:
    """A result table with fixed column order, sorted, as CSV with a header or as JSON lines."""
    out = rows.select(*columns).orderBy(*order).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


MESSAGE = "struct<severity:string,pos:struct<line:int,column:int>,endPos:struct<line:int,column:int>,data:string>"
COMPILED = f"name string, problem_id string, code string, compilation_result struct<pass:boolean,complete:boolean,system_errors:string,errors:array<{MESSAGE}>,warnings:array<{MESSAGE}>,infos:array<{MESSAGE}>,sorries:array<{MESSAGE}>>"
TERMINATION = "total_budget_calls int, raw_llm_api_calls int, total_llm_calls int, no_llm int, seedbank_debited_calls int, total_evals int, total_effective_evals int, generations_completed int, elapsed_time_seconds double, failure_type string, trigger_reason string"


def compile_results(spark: SparkSession, path: str) -> DataFrame:
    """Compile results out of JSON arrays, pretty-printed or not, flags flat; a large file is read by many tasks. Rows without a
    name are left out."""
    rows = arrays.json_array_elements(spark, path).select(F.from_json("text", COMPILED).alias("r")).select("r.*")
    r = F.col("compilation_result")
    flag = lambda n: F.coalesce(r[n], F.lit(False)).cast("int").alias(f"{n}_ok")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("problem_id"), F.lit("")))
    messages = [r[n].alias(n) for n in ("errors", "warnings", "infos", "sorries")]
    return rows.select(name.alias("name"), "code", flag("pass"), flag("complete"), r["system_errors"].alias("system_error"), *messages).where("name is not null")


def _problem_of(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -2)


def termination_logs(spark: SparkSession, path: str, name: str = "termination*.json") -> DataFrame:
    """One row for each run's termination log, run_id being its folder."""
    rows = spark.read.schema(TERMINATION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return rows.withColumn("run_id", _problem_of(F.col("_metadata.file_path")))


def missing_files(expected: DataFrame, databases: DataFrame, logs: DataFrame) -> DataFrame:
    """(run_id, missing_db, missing_log) of expected runs (run_id) that lack a database or a log."""
    have = lambda rows, n: rows.select("run_id", F.lit(False).alias(n)).distinct()
    out = expected.select("run_id").distinct().join(have(databases, "missing_db"), "run_id", "left").join(have(logs, "missing_log"), "run_id", "left")
    return out.fillna(True, ["missing_db", "missing_log"]).where("missing_db or missing_log")


def present_samples(spark: SparkSession, path: str, name: str = "metrics.json") -> DataFrame:
    """(task, sample) of result files that are not empty, from paths task/..._<sample>/name. Only the
    file listing is read, not the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path).select("path", "length")
    sample = F.regexp_extract("path", r"/[^/]*?(\d+)/[^/]+$", 1)
    return files.where((F.col("length") > 0) & (sample != "")).select(F.element_at(F.split("path", "/"), -3).alias("task"), sample.cast("int").alias("sample"))


def job_results(spark: SparkSession, path: str) -> DataFrame:
    """(job, metrics, correct, error, stdout, stderr) of result folders: metrics.json, correct.json and
    two logs; what is missing is {}, false or empty."""
    whole = lambda name: spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path).select(_problem_of(F.col("_metadata.file_path")).alias("job"), "value")
    files = {"metrics": "metrics.json", "flag": "correct.json", "stdout": "job_log.out", "stderr": "job_log.err"}
    every = None
    for kind, name in files.items():
        rows = whole(name).withColumn("kind", F.lit(kind))
        every = rows if every is None else every.unionByName(rows)
    out = every.groupBy("job").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in files])
    flag = F.from_json("flag", "correct boolean, error string")
    return out.select("job", F.coalesce("metrics", F.lit("{}")).alias("metrics"), F.coalesce(flag["correct"], F.lit(False)).alias("correct"), flag["error"].alias("error"), *[F.coalesce(k, F.lit("")).alias(k) for k in ("stdout", "stderr")])


def answers(rows: DataFrame, name: str = "theorem_name", answer: str = "answer") -> DataFrame:
    """(theorem_name, answers): blank answers left out, a single text as a list of one; null if none."""
    own = F.col(answer) if isinstance(rows.schema[answer].dataType, T.ArrayType) else F.array(answer)
    kept = F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.col(name).alias("theorem_name"), F.when(F.size(kept) > 0, kept).alias("answers"))


def labelled_union(runs: dict[str, DataFrame]) -> DataFrame:
    """The reports of several runs as one, run being their label; missing columns are null."""
    every = [rows.withColumn("run", F.lit(label)) for label, rows in runs.items()]
    out = every[0]
    for rows in every[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def write_selection(selected: DataFrame, folder: str) -> None:
    """Selected statements (problem_id, rank, signature, statement, ...) as JSON lines, and an index
    with each problem's list by rank. A list has K entries at most, as top_unique gives them."""
    selected.withColumn("id", F.concat_ws("__", F.col("problem_id").cast("string"), F.format_string("k%02d", "rank"))).write.mode("overwrite").json(f"{folder}/statements")
    entry = F.struct("rank", "signature")
    selected.groupBy("problem_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("selected")).write.mode("overwrite").json(f"{folder}/index")

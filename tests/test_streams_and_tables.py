"""Running aggregates over streams, written tables, and reasons for which candidates are left out."""

import csv
import json
import math

import pytest

from lemmaflow.operators import metrics, select
from lemmaflow.sources import readers
from lemmaflow.streaming import archive, results


def _streamed(spark, df, path, query, cut):
    """The last rows by first column that the query gives over two batches of df, cut by a condition."""
    for part in (df.where(cut), df.where(f"not ({cut})")):
        part.coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    out = {}
    keep = lambda batch, _: out.update({r[0]: tuple(r)[1:] for r in batch.collect()})
    query(stream).writeStream.outputMode("update").option("checkpointLocation", str(path / "c")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_running_best_over_batches(spark, tmp_path):
    rows = [(k % 3, k, k, [5.0, 7.0, 7.0, None, 1.0][k % 5]) for k in range(30)]
    df = spark.createDataFrame(rows, "run_id long, seq long, id long, score double")
    got = _streamed(spark, df, tmp_path, archive.running_best, "seq < 11")
    want = {}
    for run, seq, id_, score in rows:
        if score is not None and (run not in want or score > want[run][1]):
            want[run] = (id_, score)
    assert got == want


def test_failures_are_counted_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(k, f"e{k % 4}", k % 3) for k in range(20)], "seq long, error_type string, repair_attempts long")
    got = _streamed(spark, df, tmp_path, archive.failure_counts, "seq < 7")
    assert got == {f"e{e}": (5, sum(k % 3 for k in range(20) if k % 4 == e)) for e in range(4)}


def test_newest_row_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "name string, at int, v string")
    assert sorted(map(tuple, archive.newest(df, "name", "at").collect())) == [("a", 3, "z"), ("b", 1, None)]


def test_tables_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "c,d", None), (1, 'a"b', 0.5), (2, "", 1e-7)], "k int, name string, x double").repartition(3)
    readers.write_table(df, str(tmp_path / "t"), ["name", "k"], ["k"])
    rows = [r for f in sorted((tmp_path / "t").glob("part*")) for r in csv.reader(f.open(), escapechar="\\")]
    assert [r for r in rows if r != ["name", "k"]] == [['a"b', "1"], ["", "2"], ["c,d", "3"]] and rows[0] == ["name", "k"]
    readers.write_table(df, str(tmp_path / "j"), ["k", "x"], ["k"], "json")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [{"k": 1, "x": 0.5}, {"k": 2, "x": 1e-7}, {"k": 3}]


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("-inf"), None, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(metrics.finite_array(df["v"])).collect()] == [[1.0, None, None, None, 2.0], None]


def test_reasons_for_leaving_out(spark):
    rows = spark.createDataFrame([("p", 0, "h"), ("p", 5, "h"), ("q", 1, "by sorry"), ("q", 2, None), ("x", 0, "sorry"), (None, 0, "h"), ("p", None, "h")], "problem_id string, index int, header string")
    listed = spark.createDataFrame([("p",), ("q",), ("q",)], "problem_id string")
    got = {(r.problem_id, r["index"]): r.skipped for r in select.admitted(rows, listed, 5, "header").collect()}
    assert got == {("p", 0): None, ("p", 5): "beyond_first", ("q", 1): "header", ("q", 2): None, ("x", 0): "not_listed", (None, 0): "not_listed", ("p", None): "beyond_first"}
    assert {r.reason: r["rows"] for r in select.skipped_counts(select.admitted(rows, listed, 5, "header")).collect()} == {"kept": 2, "beyond_first": 2, "header": 1, "not_listed": 2}
    assert {r.reason: r["rows"] for r in select.skipped_counts(select.admitted(rows)).collect()} == {"kept": 7}


def test_ranks_of_likelihoods(spark):
    rows = spark.createDataFrame([(1, "k", -4.0, 4), (2, "k", -1.0, 0), (3, "k", float("-inf"), 2), (4, "k", -2.0, 4), (5, "k", float("nan"), 1)], "id int, g string, lp double, n int")
    by_token = {r.id: (r["rank"], r.probability) for r in select.likelihood_ranks(rows, ["g"], "lp", "n", temperature=1.0).collect()}
    top = 1 / (1 + math.exp(-0.5))
    assert {k: v[0] for k, v in by_token.items()} == {4: 1, 1: 2, 2: 3, 3: 4, 5: 5}
    assert by_token[4][1] == pytest.approx(top) and by_token[1][1] == pytest.approx(1 - top) and by_token[2][1] == by_token[3][1] == by_token[5][1] == 0.0
    assert {r.id: r["rank"] for r in select.likelihood_ranks(rows, ["g"], "lp").collect()} == {2: 1, 4: 2, 1: 3, 3: 4, 5: 5}


def test_costs_of_unknown_models(spark):
    log = spark.createDataFrame([("a", "m", 2.0), ("a", "n", 3.0), ("b", None, 1.0)], "kind string, model string, units double")
    prices = spark.createDataFrame([("m", 1.5)], "model string, price double")
    assert sorted(map(tuple, metrics.query_costs(log, prices, ["kind"], "model", "units").collect())) == [("a", 2, 3.0, 1), ("b", 1, 0.0, 1)]


def test_superseded_versions_go(spark, tmp_path):
    from pyspark.sql import functions as F

    merge, place = results.upsert_newest(str(tmp_path / "out"), "name", "at", 4), str(tmp_path / "out")
    assert results.drop_superseded(spark, place, 9) == 0
    for batch in range(4):
        rows = spark.createDataFrame([(f"n{k}", batch, k) for k in range(batch, 12, 2)], "name string, at int, ok int")
        merge(rows, batch)
    schema = rows.withColumn("bucket", F.lit(0)).schema
    whole = sorted(map(tuple, results.latest(spark, place, schema).select("name", "at", "ok").collect()))
    earlier = sorted(map(tuple, results.latest(spark, place, schema, before=3).select("name", "at", "ok").collect()))
    gone = results.drop_superseded(spark, place, 3)
    assert gone > 0 and results.drop_superseded(spark, place, 3) == 0
    assert sorted(map(tuple, results.latest(spark, place, schema).select("name", "at", "ok").collect())) == whole
    assert sorted(map(tuple, results.latest(spark, place, schema, before=3).select("name", "at", "ok").collect())) == earlier
    merge(rows, 3)  # the last batch runs again
    assert sorted(map(tuple, results.latest(spark, place, schema).select("name", "at", "ok").collect())) == whole

"""Run databases as a Spark data source: spark.read.format("run_databases").load(folder).

A database is a SQLite file that every task can open by its path, in a folder that driver and executors share. Large ones
are read in ranges of row ids, each by a task of its own; conditions on plain columns are passed on to the database. A file is
never held whole.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: The file's name in a run's folder, and the table in it.
FILE, TABLE = "evolution_db.sqlite", "programs"
COLUMNS = {
    "id": "string", "code": "string", "parent_id": "string", "generation": "int", "timestamp": "double", "combined_score": "double", "public_metrics": "string", "private_metrics": "string",
    "metadata": "string", "correct": "boolean", "island_idx": "int", "embedding": "string",
}
SCHEMA = "run_id string, seq long, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_PYTHON = {"string": str, "int": int, "long": int, "double": float, "boolean": bool}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows that a task reads at most, about, and rows of a batch.
ROWS, BATCH = 200_000, 2_000
#: Tasks of a read at most, about: in all, and for each core where a session says how many it has. A task costs some tenths
#: of a second, however little it reads.
TASKS, CORE_TASKS = 1_000, 16


def local_path(path: str) -> str:
    """The path of a file: address; any other store has to be mounted first."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"run databases are opened by path, not in {parts.scheme}:")
    return unquote(parts.path)


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro&immutable=1", uri=True)


class Ranges(InputPartition):
    """What a task reads: (file, first row id, last row id), one after the other."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class RunReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.folder, self.rows, self.tasks, self.names = local_path(options["path"]), int(options.get("rows", ROWS)), int(options.get("tasks", TASKS)), names
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the table's columns and on seq go to the database; Spark checks them again."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in COLUMNS or name == "seq":
                column = "rowid" if name == "seq" else name
                if type(f) in _SIGNS and not isinstance(f.value, bytes):
                    self.conditions.append((f"{column} {_SIGNS[type(f)]} ?", [f.value]))
                elif isinstance(f, In) and len(f.value) <= 500:
                    self.conditions.append((f"{column} in ({', '.join('?' * len(f.value))})", list(f.value)))
                elif isinstance(f, IsNotNull):
                    self.conditions.append((f"{column} is not null", []))
            yield f

    def partitions(self) -> list[Ranges]:
        """Ranges of `rows` row ids; where these are more than `tasks`, a task reads several, in turn."""
        files = []
        for path in sorted(glob.glob(os.path.join(glob.escape(self.folder), "**", FILE), recursive=True)):
            try:
                with opened(path) as db:
                    first, last = db.execute(f"select min(rowid), max(rowid) from {TABLE}").fetchone()
            except sqlite3.Error:  # no database, or without the table: a run that never began
                continue
            if first is not None:
                files.append((path, first, last))
        each = -(-sum((last - first) // self.rows + 1 for _, first, last in files) // self.tasks)
        out, room = [Ranges([])], each
        for path, first, last in files:
            for k in range(first, last + 1, self.rows * each):
                end = min(k + self.rows * each - 1, last)
                took = (end - k) // self.rows + 1
                if took > room:
                    out.append(Ranges([]))
                    room = each
                out[-1].ranges.append((path, k, end))
                room -= took
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, first, last in partition.ranges:
            yield from self._read(path, first, last)

    def _read(self, path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        kinds = {"run_id": "string", "seq": "long", **COLUMNS}
        with opened(path) as db:
            have = {r[1] for r in db.execute(f"pragma table_info({TABLE})")}
            usable = [(c, v) for c, v in self.conditions if c.split(" ")[0] in have | {"rowid"}]
            where = " and ".join(["rowid between ? and ?", *(c for c, _ in usable)])
            values = [first, last, *(x for _, v in usable for x in v)]
            own = [n if n in have else f"null as {n}" for n in COLUMNS]
            rows = db.execute(f"select rowid, {', '.join(own)} from {TABLE} where {where} order by rowid", values)
            run, metrics = os.path.basename(os.path.dirname(path)), 1 + list(COLUMNS).index("public_metrics")
            while batch := rows.fetchmany(BATCH):
                columns = list(zip(*[(run, *r) for r in batch if is_object(r[metrics])])) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([_typed(x, kinds[n]) for x in columns[list(kinds).index(n)]], _ARROW[kinds[n]]) for n in self.names], self.names)


def _typed(value, kind: str):
    """SQLite lets any value stand in any column; what does not fit is null."""
    try:
        return None if value is None else _PYTHON[kind](value)
    except (TypeError, ValueError, OverflowError):
        return None


def is_object(text: str | None) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (TypeError, ValueError, RecursionError):
        return False


class RunDatabases(DataSource):
    """Options: path, the folder above the runs' folders; rows, how many row ids a task reads; tasks, how many there are at most,
    about: each reads more where they would not do."""

    @classmethod
    def name(cls) -> str:
        return "run_databases"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RunReader:
        return RunReader(dict(self.options), [f.name for f in schema.fields])


def run_databases(spark: SparkSession, folder: str, rows: int = ROWS) -> DataFrame:
    """Programs of all run databases under a folder: run_id (the run's folder), seq (the row id) and the table's columns, null where a
    database lacks one. Rows whose metrics are null or no JSON object are left out; unreadable files give no rows."""
    spark.dataSource.register(RunDatabases)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("run_databases").option("rows", rows).option("tasks", CORE_TASKS * spark.sparkContext.defaultParallelism).load(folder)


def write_databases(rows: DataFrame, folder: str) -> None:
    """A database for each run_id of rows (run_id, seq and any of COLUMNS), in folder/run_id. A run is written by one task, a batch at a
    time in the order of seq. Files appear whole, so a task may run twice."""
    names, place = [c for c in rows.columns if c in COLUMNS], local_path(folder)
    marks = ", ".join("?" * (len(names) + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH))
        each_row = (row for b in pieces for row in zip(*[c.to_pylist() for c in b.columns]))
        for run, own_rows in itertools.groupby(each_row, lambda row: row[0]):
            own = os.path.join(place, str(run))
            os.makedirs(own, exist_ok=True)
            partial = os.path.join(own, f"{uuid.uuid4().hex}.partial")
            db = sqlite3.connect(partial)
            db.execute(f"create table {TABLE} ({', '.join(names)})")
            db.executemany(f"insert into {TABLE} (rowid, {', '.join(names)}) values ({marks})", (row[1:] for row in own_rows))
            db.commit()
            db.close()
            os.replace(partial, os.path.join(own, FILE))
            yield pa.RecordBatch.from_pydict({"run_id": [str(run)]})

    dealt = rows.select("run_id", "seq", *names).repartition("run_id").sortWithinPartitions("run_id", "seq")
    dealt.mapInArrow(write, "run_id string").write.format("noop").mode("overwrite").save()

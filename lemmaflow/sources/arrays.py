"""Text files in numbered lines, and JSON arrays of any size in elements, by many tasks a file.

Spark's text reader splits a file into blocks at any byte. What a block does not know, how many lines or elements come
before it and whether it begins inside a string, is summed up per block first and then handed
to the blocks: a row for each block is all that meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmaflow.operators.rounds import written


def _in_block() -> Window:
    return Window.partitionBy("file", "block").orderBy("at")


def pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, block, at, value): the pieces of text files between separators, at growing with the place in a block."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _before(order: Window, value: Column) -> Column:
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame, counts: Column, by_file: bool) -> DataFrame:
    """rows (file, block, at, ...) with number: how many rows for which `counts` is true come before, in the file or in all
    files by name."""
    own = rows.withColumn("_one", counts.cast("int")).withColumn("_in", _before(_in_block(), F.col("_one")))
    order = Window.partitionBy("file").orderBy("block") if by_file else Window.orderBy("file", "block")  # a row for each block
    blocks = rows.groupBy("file", "block").agg(F.sum(counts.cast("int")).alias("_n")).withColumn("_base", _before(order, F.col("_n"))).drop("_n")
    return own.join(blocks, ["file", "block"]).withColumn("number", F.col("_base") + F.col("_in")).drop("_one", "_in", "_base")


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element, text) of every object in files that hold JSON arrays, one or one after the other, pretty-printed or not, or one object; element
    is its number among the file's objects, from 0. Members that are no objects are left out. A file that
    breaks off gives the objects that are whole.

    Files are cut at every "}". A piece that begins outside a string changes the depth by other brackets than one that begins inside
    one, so both are counted, and which holds follows from the quotes before it.
    """
    value = F.regexp_replace("value", r"(?s)\\.", "")  # escapes stand in strings only, and none is cut
    brackets = lambda text: F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))
    outside = lambda text: F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    rows = pieces(spark, path, "}").withColumn("odd", F.length(F.regexp_replace(value, '[^"]', "")) % 2)
    closes = lambda begins: F.when((F.col("odd") + begins) % 2 == 0, 1).otherwise(0)  # noqa: E731  the piece's own "}"
    rows = rows.withColumns({"from_out": brackets(outside(value)) - closes(0), "from_in": brackets(outside(F.regexp_replace(value, r'\A[^"]*(?:"|\z)', ""))) - closes(1)})

    line = _in_block()
    rows = rows.withColumn("quotes", _before(line, F.col("odd")))
    even = F.col("quotes") % 2 == 0
    rows = rows.withColumns({"d0": F.when(even, F.col("from_out")).otherwise(F.col("from_in")), "d1": F.when(even, F.col("from_in")).otherwise(F.col("from_out"))})
    rows = written(rows.withColumns({c: F.sum(d).over(line.rowsBetween(Window.unboundedPreceding, 0)) for c, d in (("c0", "d0"), ("c1", "d1"))}).drop("from_out", "from_in"))

    order = Window.partitionBy("file").orderBy("block")
    blocks = rows.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"), F.min_by(F.left(F.ltrim(F.regexp_replace("value", r"\s", "")), F.lit(1)), "at").alias("begins"))
    blocks = blocks.withColumn("inside", _before(order, F.col("odd")) % 2)
    blocks = blocks.withColumn("depth", _before(order, F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))))
    root = F.when(F.first("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[", 1).otherwise(0)
    blocks = blocks.select("file", "block", "inside", "depth", root.alias("root"))

    known = rows.join(blocks, ["file", "block"])
    after = F.col("depth") + F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1"))
    ends = (after == F.col("root")) & ((F.col("inside") + F.col("quotes") + F.col("odd")) % 2 == 0)
    known = written(known.select("file", "block", "at", "value", ends.alias("ends")))
    whole = numbered(known, F.col("ends"), True).groupBy("file", F.col("number").alias("element")).agg(F.max("ends").alias("ends"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))  # one element's pieces
    text = F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}"))
    opening = F.when(F.col("element") == 0, r"\A\s*\[").otherwise(r"\A[\s\]]*\]\s*\[")  # an array's begin, or an array's end and the next one's begin
    members = F.regexp_replace(F.regexp_replace(text, opening, F.lit("")), r"\A[\s,]+", "")
    # members that are no objects may stand before the object, which is the last of them
    last = F.get(F.reverse(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>")), F.lit(0))
    found = whole.where("ends").select("file", "element", members.alias("text"))
    return found.select("file", "element", F.when(F.col("text").startswith("{"), F.col("text")).otherwise(last).alias("text"))

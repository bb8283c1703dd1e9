"""Line de-duplication by distinct-site spread.

A line that many sites have is boilerplate. How many distinct sites have a line is sketched with
HyperLogLog, one sketch for each line hash, merged by aggregation; lines whose estimate is near the
threshold get an exact distinct count. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import back, durable, free_name, join_spread, rest_of, row_key

#: All white space that can stand around a line.
WHITE = " \t\n\x0b\x0c\r"


def normal_line(line: Column, blanks: str = WHITE) -> Column:
    return F.lower(F.trim(line, F.lit(blanks)))


def _lines(docs: DataFrame, site: str, blanks: str) -> DataFrame:
    """One row for each line that is not blank: site, key_id, key_text, pos, line (text), hash."""
    every = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), *row_key(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.withColumn("line", normal_line(F.col("line"), blanks)).where("line <> ''").withColumn("hash", F.xxhash64("line"))


def cross_site_occurrences(docs: DataFrame, site: str = "source", min_sites: int = 10, min_words: int = 1, lg_k: int = 12, blanks: str = WHITE) -> DataFrame:
    """(key_id, key_text, pos) of every line, but the first of its kind, that min_sites or more
    distinct sites have. First is by id, text hash and position, null ids before all."""
    lines = _lines(docs, site, blanks)
    if min_words > 1:
        lines = lines.where(F.size(F.split("line", r"\s+")) >= min_words)
    # a line on so many sites has so many occurrences; this leaves few hashes, of whatever frequency
    often = durable(
        lines.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min(F.hash("site")).alias("low"), F.max(F.hash("site")).alias("high"))
        .where((F.col("n") >= min_sites) & ((F.col("low") < F.col("high")) | F.lit(min_sites <= 1)))
        .select("hash", "n")
    )
    seen = durable(join_spread(lines.drop("line"), often, "hash"))

    place = F.struct("key_id", "key_text", "pos")
    spread = durable(seen.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.count("*").alias("n"), F.min(place).alias("first")))
    band = 4 * 1.04 / 2 ** (lg_k / 2)  # four standard errors of the sketch
    near = spread.where(F.col("sites").between(min_sites * (1 - band) - 1, min_sites * (1 + band) + 1)).select("hash", "n")
    exact = join_spread(seen.select("hash", "site", "key_id", "key_text", "pos"), near, "hash").select("hash", "site").distinct().groupBy("hash").count().where(F.col("count") >= min_sites).select("hash")
    sure = spread.where(F.col("sites") > min_sites * (1 + band) + 1)
    common = durable(sure.select("hash", "n", "first").union(spread.join(exact, "hash").select("hash", "n", "first")))
    return join_spread(seen, common, "hash").where(place != F.col("first")).select("key_id", "key_text", "pos")


def remove_cross_site_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_words: int = 1, lg_k: int = 12, blanks: str = WHITE) -> DataFrame:
    """docs with cross-site boilerplate taken out of the text, and two more columns: n_lines and
    n_removed (long).

    Lines are the text's parts between "\\n". They are compared without `blanks` (all white space)
    around them and in lower case; blank lines, and lines of fewer than min_words words, are never
    removed. A null site is a site of its own. Of each boilerplate line the first occurrence stays, so
    that nothing goes altogether; rows are never dropped, and a text may become empty. Null text stays
    null with no lines. Rows with the same id and text get the same treatment. Other columns stay as
    they are, whatever their names; where docs has an n_lines or n_removed of its own, the new column
    has an underscore more.
    """
    gone = durable(cross_site_occurrences(docs, site, min_sites, min_words, lg_k, blanks).groupBy("key_id", "key_text").agg(F.collect_set("pos").alias("gone")))
    rows = docs.select(rest_of(docs, "text"), "text", *row_key()).join(gone, ["key_id", "key_text"], "left")
    rows = rows.withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.col("lines")[i]), "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long")
    return rows.select(*back(docs, text=text), n_lines.alias(free_name("n_lines", docs)), n_removed.alias(free_name("n_removed", docs)))

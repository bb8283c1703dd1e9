"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks, and each pass over a source takes its blocks
in another permuted order: whole passes, then as much of a last pass as the target leaves. So a
source has an exact quota of block slots. A binary tree splits the quotas among output shards: at
each node half of the node's slots go left, how many of each source being a multivariate
hypergeometric draw. A leaf's quotas, summed over the leaves before it, say which run of each
source's permuted slots the shard draws, so no two shards draw the same slot. Within a shard rows
are ordered by hash. Everything is DataFrame functions, and every draw is a hash of a seed, so
reruns agree.

What is held in one row or one task: one row for each source, and an array with one number for each
source in each of at most 1024 tree nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.common import WORD, back, durable, join_spread, rest_of

SEED = 20
#: Documents that a block has at most, about.
BLOCK_DOCS = 32
#: Bits of a block's number that one level of the search for a pass's end resolves.
LEVEL = 8
#: Words that a shard has at most, about, while there are fewer than 1024 shards.
SHARD_WORDS = 8_000_000


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(2**53)) / F.lit(float(2**53))


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """sources (source, source_size, ...) with sid (rank by code point, null last), weight (1, 2, 3,
    repeating by sid) and target: all words shared by weight, no source above cap times its size,
    the excess reshared by weight among the others until none is above."""
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    ranked = ranked.withColumn("weight", 1 + (F.col("sid") - 1) % 3).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), "sid")
    rows = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("most").over(rows), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(every) - before) / rest)
    # the first source, by how soon it is full, that the level does not fill
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).drop("most", "level")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, of `total` of which `marked` are marked, are marked: the inverse of
    the distribution at u (0 to 1), summed over ten standard deviations to either side of its mean."""
    share = marked / F.greatest(total, F.lit(1))
    mean = drawn * share
    sd = F.sqrt(F.greatest(mean * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    least = F.greatest(F.lit(0).cast("long"), drawn + marked - total, (F.floor(mean - 10 * sd) - 1).cast("long"))
    most = F.least(drawn, marked, (F.ceil(mean + 10 * sd) + 1).cast("long"))

    def grown(w: Column, k: Column) -> Column:
        return w * (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))

    steps = F.sequence(least, most)
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    area = F.aggregate(steps, begin, lambda a, k: F.struct(grown(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
    find = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), least.alias("x"))

    def step(limit: Column) -> Column:
        return F.aggregate(
            steps, find,
            lambda a, k: F.struct(grown(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"), (a["x"] + F.when(a["sum"] + a["w"] <= limit, 1).otherwise(0)).alias("x")),
            lambda a: F.least(a["x"], most),
        )

    draw = F.transform(F.array(area * u), step)[0]
    return F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= total, marked).otherwise(draw)


def split_quotas(root: DataFrame, levels: int) -> DataFrame:
    """(shard, quotas): the leaves of the tree under root (quotas array<struct<sid int, q long>>)."""
    kind = "array<struct<sid:int,q:long>>"
    nodes = root.select(F.lit(0).cast("long").alias("node"), F.col("quotas").cast(kind).alias("quotas"))

    def dealer(level: int):
        def deal(acc: Column, x: Column) -> Column:
            draw = hypergeometric(acc["n"], x["q"], acc["left"], _uniform(F.lit(level), F.col("node"), x["sid"]))
            put = lambda d: F.struct((acc["n"] - x["q"]).alias("n"), (acc["left"] - d).alias("left"), F.array_append(acc["out"], F.struct(x["sid"].alias("sid"), d.alias("q"))).alias("out"))
            return F.transform(F.array(draw), put)[0]

        return deal

    for level in range(levels):
        slots = F.aggregate("quotas", F.lit(0).cast("long"), lambda n, x: n + x["q"])
        nodes = nodes.withColumn("slots", slots)
        begin = F.struct(F.col("slots").alias("n"), F.expr("slots div 2").alias("left"), F.array().cast(kind).alias("out"))

        nodes = nodes.withColumn("part", F.aggregate("quotas", begin, dealer(level), lambda acc: acc["out"]))
        right = F.zip_with("quotas", "part", lambda a, b: F.struct(a["sid"].alias("sid"), (a["q"] - b["q"]).alias("q")))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("part").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas"))))
        nodes = nodes.select(child.alias("c")).select("c.node", "c.quotas")
    return nodes.withColumnRenamed("node", "shard")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, u, size): u is a hash of id, source and text; rows with the same three are
    taken or left together."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _unit(), size.alias("size"))


def _unit() -> Column:
    return F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text", "source").alias("u")


def _named(rows: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """rows with their source's columns; the rows of a hot source (docs: how many it has) are dealt to several places."""
    own = sources.select(F.struct("source").alias("_key"), F.col("docs").alias("_n"), *[c for c in sources.columns if c not in ("source", "docs")])
    return join_spread(rows.withColumn("_key", F.struct("source")), own, "_key", "_n", total).drop("_key")


def _turn(which: Column) -> Column:
    """Where the row's block comes in a pass: an odd factor and a shift permute 0..2**bits - 1."""
    mask = F.col("blocks") - 1
    block = F.col("u").bitwiseAND(mask)
    factor = F.pmod(F.xxhash64(F.lit(SEED + 1), "sid", which), F.lit(2**20)) * 2 + 1
    shift = F.pmod(F.xxhash64(F.lit(SEED + 2), "sid", which), F.lit(2**30))
    return (block * factor + shift).bitwiseAND(mask)


class Mix:
    """The mix of a table of documents: what each source gives and what each shard gets."""

    def __init__(self, docs: DataFrame, cap: int = 3, block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS):
        self.docs = docs
        self.sized = durable(sized(docs))
        totals = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        sources = targets(totals, cap)
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / block_docs))).cast("int")
        sources = sources.withColumn("passes", passes).withColumn("bits", bits).withColumn("blocks", F.expr("shiftleft(1L, bits)"))
        sources = durable(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
        facts = sources.agg(F.max("bits"), F.sum("source_size"), F.sum("docs")).first()  # three numbers
        self.total = facts[2] or 0
        self._find_ends(sources, facts[0] or 0)
        words = facts[1] or 0
        self._deal(min(10, max(4, math.ceil(math.log2(max(1, words / shard_words))))))

    def _find_ends(self, sources: DataFrame, bits: int) -> None:
        """Where each source's last, partial pass ends: the block (end) and, of that block, the
        documents that still fit (self.last). Level by level, a group of at most 256 is summed and
        searched in each source, so no source's blocks ever meet in one task."""
        at = sources.select("source", "docs", "sid", "passes", "blocks", F.lit(0).cast("long").alias("end"), F.col("bits").alias("width"), F.col("rest").alias("need"))
        for _ in range(max(1, math.ceil(bits / LEVEL))):
            rows = _named(self.sized, at, self.total).withColumn("o", _turn(F.col("passes")))
            step = F.greatest(F.col("width") - LEVEL, F.lit(0))
            rows = rows.where(F.expr("shiftright(o, width) = shiftright(end, width)")).withColumn("step", step).withColumn("g", F.expr("shiftright(o, step)"))
            sums = rows.groupBy("sid", "step", "g").agg(F.sum("size").alias("words"))
            sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("sid").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))
            found = sums.join(at.select("sid", "need"), "sid").where(F.col("upto") >= F.col("need")).groupBy("sid").agg(F.min(F.struct("g", "step", (F.col("need") - F.col("upto") + F.col("words")).alias("left"))).alias("f"))
            at = at.join(found, "sid", "left")
            some = F.col("f").isNotNull()
            at = durable(
                at.select(
                    "source", "docs", "sid", "passes", "blocks",
                    F.when(some, F.expr("shiftleft(f.g, f.step)")).otherwise(F.col("blocks")).alias("end"),
                    F.when(some, F.col("f.step")).otherwise(0).alias("width"), F.when(some, F.col("f.left")).otherwise(0.0).alias("need"),
                )
            )
        rows = _named(self.sized, at, self.total).where(_turn(F.col("passes")) == F.col("end"))
        units = rows.groupBy("sid", "u", "need").agg(F.sum("size").alias("words"))
        lists = units.groupBy("sid", "need").agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("less"), "u", "words"))).alias("units"))  # one block: some dozen units, largest first
        begin = F.struct(F.col("need").alias("left"), F.array().cast("array<long>").alias("took"))
        fit = lambda a, x: F.when(x["words"] <= a["left"], F.struct((a["left"] - x["words"]).alias("left"), F.array_append(a["took"], x["u"]).alias("took"))).otherwise(a)
        took = lists.select("sid", F.explode(F.aggregate("units", begin, fit, lambda a: a["took"])).alias("u"))
        self.last = durable(took.withColumn("fits", F.lit(True)))
        self.sources = sources.join(at.select("sid", "end"), "sid")

    def _deal(self, levels: int) -> None:
        """Splits the sources' slots among 2 ** levels shards; sources get starts, an array with the
        first slot of each shard, and drawn, how many slots the shards draw in all."""
        self.levels = levels
        slots = F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, F.least(F.col("end") + 1, F.col("blocks"))).otherwise(0)
        root = self.sources.agg(F.array_sort(F.collect_list(F.struct("sid", slots.cast("long").alias("q")))).alias("quotas"))
        leaves = split_quotas(root, levels).select("shard", F.explode("quotas").alias("x")).select("shard", "x.sid", "x.q")
        before = F.coalesce(F.sum("q").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = leaves.withColumn("first", before.cast("long")).groupBy("sid").agg(F.array_sort(F.collect_list("first")).alias("starts"), F.sum("q").alias("drawn"))
        self.sources = durable(self.sources.join(starts, "sid"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (source, u and any others) with their source's columns and placements: an array of
        (pass, shard), empty for rows that the mix leaves out. A pass takes a row where some shard of the tree draws
        its block's slot; of the last slot's block only what fits is taken."""
        rows = _named(rows, self.sources, self.total).join(self.last, ["sid", "u"], "left")
        cut = F.when(F.col("rest") > 0, F.col("passes") * F.col("blocks") + F.col("end"))
        slots = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.struct(p.cast("int").alias("pass"), (p * F.col("blocks") + _turn(p)).alias("slot")))
        taken = lambda x: (x["slot"] < F.col("drawn")) & (F.coalesce(x["slot"] != cut, F.lit(True)) | F.col("fits").isNotNull())
        return rows.withColumn("placements", F.transform(F.filter(slots, taken), lambda x: F.struct(x["pass"].alias("pass"), self._shard(x["slot"]).alias("shard"))))

    def _shard(self, slot: Column) -> Column:
        """The last shard whose first slot is not behind slot, by halving: a step for each level of the tree, not for each shard."""
        halves = F.array(*[F.lit(2**k) for k in reversed(range(self.levels))])
        return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("starts", at + half) <= slot, at + half).otherwise(at))


def mix_report(docs: DataFrame, cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, shards), one row for every row of docs: passes are the
    numbers of the source's passes that take the document, and shards what shard of the tree draws it in each.

    Null text has size 0; a null source is a source, the last one. taken is the words the mix takes,
    at most cap times size; each source's sum is within its smallest fitting document of its target.
    Rows without an id are mixed too. Repeated rows are taken together. Empty table: no rows.
    """
    mix = Mix(docs, cap)
    return mix.placed(mix.sized).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("placements")).alias("taken"), F.col("placements.pass").alias("passes"), F.col("placements.shard").alias("shards"),
    )


def mix(docs: DataFrame, cap: int = 3) -> DataFrame:
    """The mix itself: docs' rows, each as often as the mix takes it, in shard order and, within a
    shard, in hashed order. Columns stay as they are."""
    own = Mix(docs, cap)
    rows = docs.select(rest_of(docs), F.col("source").cast("string").alias("source"), _unit())
    rows = own.placed(rows).select("row", "u", F.explode("placements").alias("p"))
    rows = rows.select("row", F.col("p.shard").alias("shard"), F.xxhash64(F.lit(SEED + 3), "u", "p.pass").alias("order"))
    return rows.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select(*back(docs))

"""How the sources of a language differ in their words.

Identical texts of a language are collapsed first: what is kept of the copies is how many of them each
source has. A text is then cut into terms once, however many copies there are, and its counts and its
document frequencies enter with those numbers. Sources are compared term by term where either has the
term; what all other terms add follows from their number. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.llm.common import durable, forget, join_spread

#: What stands between terms, which are runs of letters A to Z and of all characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole billionths, counts are raised by this much.
UNIT, RAISE = 1_000_000_000, 5


def terms_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, BETWEEN), "")


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a language's source, and in how many of
    its documents.

    A text is known by its SHA-256. Copies become one row for each (language, text, source) before the
    shuffle, so that a text that a third of all rows share is no hot key; its terms are counted where
    the text lies, without another shuffle.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = rows.groupBy("lang", "key", "source").agg(F.count("*").alias("copies"))
    once = rows.select("lang", "key", "text").dropDuplicates(["lang", "key"])
    terms = once.select("lang", "key", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("lang", "key", "term").agg(F.count("*").alias("n"))
    weighted = terms.join(copies.hint("shuffle_hash"), ["lang", "key"])
    return weighted.groupBy("lang", "term", "source").agg(F.sum(F.col("n") * F.col("copies")).alias("n"), F.sum("copies").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + RAISE) / (total + RAISE * terms)) in whole numbers of 38 digits; null without terms."""
    return F.when(terms > 0, 1 + F.call_function("div", (n + RAISE).cast("decimal(20,0)") * F.lit(UNIT), (total + RAISE * terms).cast("decimal(20,0)")))


def source_divergence(docs: DataFrame, min_docs: int = 30, most_terms: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    A language keeps the terms that at least min_docs of its documents have; a group is the documents of
    a language and source, and its share of a term is as in share(). Part `pair`: for every two groups
    of a language, the sum over its kept terms of the shares' differences; every group is ranked
    against every other one. Part `term`: a group's terms whose share is above the language's, by the
    difference, the first most_terms of them. Equal values are ranked by item.

    A null text, language or source counts as ''. A group without terms is compared, too; where a
    language keeps no term all its pairs have 0. Repeated rows count as often as they come; other
    columns are not read. No rows give no rows.

    Pairs of groups are the result, so its size is the square of a language's sources; terms meet by
    (language, term), with as many rows as there are sources that have the term.
    """
    counts = durable(term_counts(docs, text, lang, source))
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]).distinct()

    kept = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    langs = durable(kept.groupBy("lang").agg(F.sum("all_n").alias("total"), F.count("*").alias("v")))
    typical = join_spread(kept, langs.withColumn("n", F.col("v")), "lang").select("lang", "term", share(F.col("all_n"), F.col("total"), F.col("v")).alias("q"))
    own = durable(counts.join(typical, ["lang", "term"]).select("lang", "source", "term", "n", "q"))
    forget(counts, kept)

    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    zero = F.lit(0).cast("long")
    facts = groups.join(sums, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left").na.fill(0, ["total", "k", "v"])
    facts = durable(facts.withColumn("none", F.coalesce(share(zero, F.col("total"), F.col("v")), zero)))  # a group's share of a term it lacks
    by_group = facts.where("k > 0").select(F.struct("lang", "source").alias("group"), "total", "v", "none", F.col("k").alias("n"))
    shares = durable(
        join_spread(own.select(F.struct("lang", "source").alias("group"), "term", "q", F.col("n").alias("had")), by_group, "group")
        .select("group.lang", "group.source", "term", "q", share(F.col("had"), F.col("total"), F.col("v")).alias("p"), "none")
    )
    forget(own)

    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = above.withColumn("rank", place).where(F.col("rank") <= most_terms)

    ranked = pair_values(shares, facts).withColumn("rank", place)
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(top)


def pair_values(shares: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language.

    For groups a and b with shares p and z of the terms that they have and lack, the sum over all V kept
    terms is that of |p_a - z_b| over a's terms, of |p_b - z_a| over b's, of a correction over the
    terms of both, and (V - a's terms - b's terms) * |z_a - z_b|. The first two need only how often each
    share occurs in a group, which is a short list.
    """
    lone = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    lone_rows = lone.groupBy("lang").agg(F.count("*").alias("n"))
    others = facts.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("none").alias("z"))).alias("others")).join(lone_rows, "lang")  # the sources of a language
    met = join_spread(lone, others, "lang").select("lang", "source", "p", "times", F.explode("others").alias("o")).where("source <> o.item")
    alone = met.groupBy("lang", "source", F.col("o.item").alias("item")).agg(F.sum(F.abs(F.col("p") - F.col("o.z")) * F.col("times")).alias("value"))

    a, b = (shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("none").alias(f"z{x}")) for x in "ab")
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item"))
    common = both.agg(F.sum(F.expr("abs(pa - pb) - abs(pa - zb) - abs(pb - za) + abs(za - zb)")).alias("value"))

    one, two = (facts.select("lang", "v", F.col("source").alias(x), F.col("k").alias(f"k{x}"), F.col("none").alias(f"z{x}")) for x in "ab")
    rest = one.join(two.drop("v"), "lang").where("a <> b").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.expr("(v - ka - kb) * abs(za - zb)").alias("value"))

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = alone.union(turned(alone)).union(common).union(turned(common)).union(rest)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

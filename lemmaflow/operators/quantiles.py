"""Exact quantiles of groups of any size, without a sort of a group in one task.

A quantile lies between two order statistics. Each is found by rounds: values drawn from what is left of its group, by a
sketch, cut it into intervals; rows are counted in these (partial aggregates), and the interval that has
the wanted place is what is left. A round leaves about one in CUTS of the rows, so rounds are few; when at most
FEW are left, they are sorted. A value that fills many places is met as a cut and ends the search at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.operators.rounds import written

CUTS, FEW = 64, 2048


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], few: int = FEW) -> DataFrame:
    """keys and a column for each of points, the quantile of that share with linear interpolation as percentile() has it; rows
    with a null value are left out, and groups without others are missing. Not-a-number is the greatest value."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_"))
    data = rows.where(F.col(value).isNotNull()).select(group.alias("g"), (F.col(value).cast("double") + 0.0).alias("x"))
    sizes = data.groupBy("g").agg(F.count("*").alias("n"))
    at = lambda p, f: f(F.lit(float(p)) * (F.col("n") - 1)).cast("long")
    places = F.array(*[f for p in points.values() for f in (at(p, F.floor), at(p, F.ceil))])
    # left: rows of the group above low (null: from the start) and below high; place: the wanted one among them, from 0
    state = sizes.select("g", F.explode(F.array_distinct(places)).alias("rank"), "n").select("g", "rank", F.col("rank").alias("place"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.col("n").alias("left"), F.lit(None).cast("double").alias("found"))
    state = written(state)

    def inside(open_: DataFrame) -> DataFrame:
        """(g, rank, x) of the rows that are left for each place."""
        own = open_.select("g", "rank", "low", "high", "place")
        return data.join(own, "g").where((F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high"))))

    while True:
        large = state.where(F.col("found").isNull() & (F.col("left") > few))
        if large.isEmpty():
            break
        rest = inside(large)
        cuts = rest.groupBy("g", "rank").agg(F.array_distinct(F.percentile_approx("x", [(k + 0.5) / CUTS for k in range(CUTS)], 10 * CUTS)).alias("cuts"))
        # interval 2i lies below cut i and above the one before it; 2i + 1 is cut i itself
        below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
        part = 2 * below + F.coalesce((F.get("cuts", below) == F.col("x")).cast("int"), F.lit(0))
        counts = rest.join(cuts, ["g", "rank"]).groupBy("g", "rank", "place", "low", "high", part.alias("part")).agg(F.count("*").alias("k"), F.any_value("cuts").alias("cuts"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy("g", "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 2 * CUTS + 1 rows at most
        hit = counts.withColumn("before", before).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("k")))
        i = F.floor(F.col("part") / 2).cast("int")
        cut = F.col("part") % 2 == 1
        narrowed = hit.select(
            "g", "rank", (F.col("place") - F.col("before")).alias("place"), F.coalesce(F.when(i > 0, F.get("cuts", i - 1)), F.col("low")).alias("low"), F.coalesce(F.get("cuts", i), F.col("high")).alias("high"),
            F.col("k").alias("left"), F.when(cut, F.get("cuts", i)).alias("found"),
        )
        state = written(state.where(~(F.col("found").isNull() & (F.col("left") > few))).union(narrowed))

    small = state.where("found is null")
    sorted_rest = inside(small).groupBy("g", "rank", "place").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # `few` at most
    found = state.where("found is not null").select("g", "rank", "found").union(sorted_rest.select("g", "rank", F.get("xs", F.col("place").cast("int")).alias("found")))
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("m"))  # two entries a point

    def quantile(p: float) -> Column:
        low, high = (F.try_element_at("m", at(p, f)) for f in (F.floor, F.ceil))
        share = F.lit(float(p)) * (F.col("n") - 1) - at(p, F.floor)
        return F.when(low == high, low).otherwise(low + share * (high - low))

    out = sizes.join(values, "g")
    return out.select(*[F.col(f"g.`{k}`") for k in keys], *[quantile(p).alias(name) for name, p in points.items()])

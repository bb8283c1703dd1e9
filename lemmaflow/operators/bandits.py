"""Bandit state in log space: totals, pulls and the greatest gain seen, in batch and stream.

A gain z adds exp(z) - 1 to its arm's total S, and every reward of a bandit then shrinks the totals of
all its arms to f * S / (1 + (1 - f) * S), their pulls to f times. Only logarithms are kept, so
gains of any size count. Adding and shrinking are fractions of linear terms in S with no negative
part: a run of them is a 2 x 2 matrix of logarithms, k shrinks being one shrink by f ** k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.operators.rounds import written

NONE = float("-inf")
#: Fixed value: pulls count as so many at least where a mean is formed.
LEAST_PULLS = 1e-7


def log_gain(z: float | None) -> float:
    """log(exp(z) - 1); nothing for a gain of 0 or none."""
    if z is None or not z > 0:
        return NONE
    return z + math.log(-math.expm1(-z))


def log_add(a: float, b: float) -> float:
    high, low = (a, b) if a >= b else (b, a)
    return high if low == NONE else high + math.log1p(math.exp(low - high))


def shrunk(x: float, times: int, decay: float) -> float:
    """log of a total of log x after so many shrinks."""
    if x == NONE or times == 0 or decay == 1.0:
        return x
    lost = -math.expm1(times * math.log(decay))  # 1 - f ** times
    return x + times * math.log(decay) - log_add(0.0, x + math.log(lost))


class Arm:
    """One arm's log total and pulls, as of the reward number `at` of its bandit."""

    __slots__ = ("at", "pulls", "total")

    def __init__(self, total: float = NONE, pulls: float = 0.0, at: int = 0) -> None:
        self.total, self.pulls, self.at = total, pulls, at

    def until(self, at: int, decay: float) -> None:
        self.total, self.pulls, self.at = shrunk(self.total, at - self.at, decay), self.pulls * decay ** (at - self.at), at

    def mean(self) -> float:
        return self.total - math.log(max(self.pulls, LEAST_PULLS))

    def pull(self, at: int, z: float | None, decay: float) -> float:
        """Reward number at: the greatest of what the range of gains meets, shrunk to `at`: the gain itself, and the
        arm's mean before and after. Between two pulls that mean, shrunk to the end, is greatest at either end."""
        self.until(at - 1, decay)
        met = max(log_gain(z), self.mean())
        self.total, self.pulls = log_add(self.total, log_gain(z)), self.pulls + 1.0
        self.until(at, decay)
        return max(shrunk(met, 1, decay), self.mean())


#: Matrices (a, b, c, d) of logarithms: S becomes (a * S + b) / (c * S + d).
UNIT = (0.0, NONE, NONE, 0.0)


def then(m: tuple, n: tuple) -> tuple:
    """n after m."""
    a, b, c, d = m
    p, q, r, s = n
    return log_add(p + a, q + c), log_add(p + b, q + d), log_add(r + a, s + c), log_add(r + b, s + d)


def pulled(z: float | None) -> tuple:
    return 0.0, log_gain(z), NONE, 0.0


def shrinking(times: int, decay: float) -> tuple:
    lost = -math.expm1(times * math.log(decay)) if times and decay < 1.0 else 0.0
    return times * math.log(decay), NONE, math.log(lost) if lost else NONE, 0.0


def applied(m: tuple, total: float) -> float:
    a, b, c, d = m
    return log_add(a + total, b) - log_add(c + total, d)


_PART = "bandit long, piece long, arm string, a double, b double, c double, d double, pulls double, n long"
_STATE = "bandit long, piece long, arm string, total double, pulls double"
_SEEN = "bandit long, seen double"


def bandit_log_totals(log: DataFrame, decay: float = 0.95, chunk: int = 65536) -> DataFrame:
    """(bandit, arm, pulls, log_total, log_range) after a whole log (bandit, seq, arm, gain).

    log_total is -inf without a gain; log_range is the bandit's greatest log gain, which shrinks with every reward
    like a total and is never below an arm's log mean. Gains that are null or not above 0 count as none.
    Rewards with the same seq of a bandit are taken by arm and gain.

    The log is sorted by bandit and seq over the whole cluster and cut into chunks, so that one bandit's log may fill
    many tasks. A first pass makes each arm's matrix in each chunk; an arm's chunks, a row each, are then
    combined to its state before each chunk; a second pass goes through the chunks from there for the
    range. What meets in one task is a chunk, or a row for each chunk of an arm.
    """
    rows = log.select(F.col("bandit").cast("long"), "seq", F.col("arm").cast("string"), F.col("gain").cast("double"))
    parts = max(1, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, "bandit", "seq", "arm", F.coalesce("gain", F.lit(0.0))).sortWithinPartitions("bandit", "seq", "arm", F.coalesce("gain", F.lit(0.0)))
    place = F.monotonically_increasing_id()
    # a chunk's number grows in the order of the log: the partition, then its part of it
    numbered = written(sorted_rows.select("bandit", "arm", "gain", place.alias("place"), (F.shiftright(place, 33) * (1 << 33) + F.floor(place.bitwiseAND((1 << 33) - 1) / chunk)).alias("piece")))

    def fold(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        out = []
        for bandit, own in t.sort_values("place").groupby("bandit", sort=False):
            arms: dict[str, list] = {}
            for at, (arm, z) in enumerate(zip(own["arm"], own["gain"]), 1):
                state = arms.setdefault(arm, [UNIT, 0, 0.0])
                m = then(state[0], shrinking(at - 1 - state[1], decay)) if at - 1 > state[1] else state[0]
                state[0], state[2] = then(then(m, pulled(z if z == z else None)), shrinking(1, decay)), (state[2] * decay ** (at - 1 - state[1]) + 1.0) * decay
                state[1] = at
            for arm, (m, at, pulls) in arms.items():
                last = then(m, shrinking(len(own) - at, decay))
                out.append((bandit, key[0], arm, *last, pulls * decay ** (len(own) - at), len(own)))
        return pd.DataFrame(out, columns=["bandit", "piece", "arm", "a", "b", "c", "d", "pulls", "n"])

    folded = written(numbered.groupBy("piece").applyInPandas(fold, _PART))
    order = Window.partitionBy("bandit").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = folded.select("bandit", "piece", "n").distinct().withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    pieces = written(pieces)
    lengths = pieces.groupBy("bandit").agg(F.max(F.col("before") + F.col("n")).alias("length"))

    def combine(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        """The arm's state before each of its chunks, and (piece -1) at the end."""
        out, total, pulls, at = [], NONE, 0.0, 0
        for r in t.sort_values("piece").itertuples(index=False):
            total, pulls = shrunk(total, r.before - at, decay), pulls * decay ** (r.before - at)
            out.append((key[0], r.piece, key[1], total, pulls))
            total, pulls, at = applied((r.a, r.b, r.c, r.d), total), pulls * decay**r.n + r.pulls, r.before + r.n
        left = int(t["length"].iloc[0]) - at
        out.append((key[0], -1, key[1], shrunk(total, left, decay), pulls * decay**left))
        return pd.DataFrame(out, columns=["bandit", "piece", "arm", "total", "pulls"])

    joined = folded.drop("n").join(pieces, ["bandit", "piece"]).join(lengths, "bandit")
    states = written(joined.groupBy("bandit", "arm").applyInPandas(combine, _STATE))
    starts = states.where("piece >= 0").join(pieces, ["bandit", "piece"]).join(lengths, "bandit")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        begun = {b: own for b, own in right.groupby("bandit", sort=False)}
        out = []
        for bandit, own in left.sort_values("place").groupby("bandit", sort=False):
            start = begun[bandit]
            arms = {r.arm: Arm(r.total, r.pulls) for r in start.itertuples(index=False)}
            after, seen = int(start["length"].iloc[0]) - int(start["before"].iloc[0]), NONE
            for at, (arm, z) in enumerate(zip(own["arm"], own["gain"]), 1):
                seen = max(seen, shrunk(arms[arm].pull(at, z if z == z else None, decay), after - at, decay))
            out.append((bandit, seen))
        return pd.DataFrame(out, columns=["bandit", "seen"])

    seen = numbered.groupBy("piece").cogroup(starts.groupBy("piece")).applyInPandas(meet, _SEEN).groupBy("bandit").agg(F.max("seen").alias("seen"))
    ends = states.where("piece = -1")
    means = ends.groupBy("bandit").agg(F.max(F.col("total") - F.log(F.greatest("pulls", F.lit(LEAST_PULLS)))).alias("mean"))
    ranges = seen.join(means, "bandit").select("bandit", F.greatest("seen", "mean").alias("log_range"))
    return ends.join(ranges, "bandit").select("bandit", "arm", "pulls", F.col("total").alias("log_total"), "log_range")


def arm_scores(state: DataFrame, exploration: float = 1.0) -> DataFrame:
    """(bandit, arm, mean, score) of bandit_log_totals with a column n of an arm's rewards so far: mean is the arm's
    mean over the bandit's range, both out of log space, and score adds exploration * sqrt(2 log N / n)."""
    log_mean = F.col("log_total") - F.log(F.greatest("pulls", F.lit(LEAST_PULLS)))
    mean = F.when(F.col("log_range") > NONE, F.exp(log_mean - F.col("log_range"))).otherwise(F.exp(log_mean))
    whole = F.sum("n").over(Window.partitionBy("bandit"))  # a row an arm
    return state.select("bandit", "arm", mean.alias("mean"), (mean + exploration * F.sqrt(2 * F.log(F.greatest(whole, F.lit(2))) / F.col("n"))).alias("score"))


def bandit_log_stream(log: DataFrame, decay: float = 0.95) -> DataFrame:
    """The columns of bandit_log_totals over a stream: a bandit's state is its arms, its number of rewards and the range; a
    batch's rows are taken in the order of the batch operator."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, totals, pulls, at, seen = state.get if state.exists else ([], [], [], 0, NONE)
        arms = {a: Arm(t, p, at) for a, t, p in zip(names, totals, pulls)}
        rows = pd.concat(list(batches))
        for arm, z in rows.assign(_z=rows["gain"].fillna(0.0)).sort_values(["seq", "arm", "_z"])[["arm", "gain"]].itertuples(index=False):
            at += 1
            seen = max(shrunk(seen, 1, decay), arms.setdefault(arm, Arm(at=at - 1)).pull(at, z if z == z else None, decay))
        for x in arms.values():
            x.until(at, decay)
            seen = max(seen, x.mean())
        state.update((list(arms), [x.total for x in arms.values()], [x.pulls for x in arms.values()], at, seen))
        yield pd.DataFrame([(key[0], a, x.pulls, x.total, seen) for a, x in arms.items()], columns=["bandit", "arm", "pulls", "log_total", "log_range"])

    return log.groupBy("bandit").applyInPandasWithState(
        fold, "bandit long, arm string, pulls double, log_total double, log_range double", "arms array<string>, totals array<double>, pulls array<double>, at long, seen double", "update", "NoTimeout"
    )

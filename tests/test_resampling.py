"""Resampling against all possible outcomes of a few rows, and against theory for many."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaflow.operators import resampling as S

FEW = [0.5, -0.25, 0.75, 0.75, 1.0, -0.5, 0.25, 0.0, 0.125, 0.75, -0.125, 0.375]


def _rows(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "problem_id int, d double")


def test_sign_flips_against_all_patterns(spark):
    total = sum(FEW)
    exact = sum(abs(sum(s * d for s, d in zip(signs, FEW))) >= abs(total) - 1e-12 for signs in itertools.product((1, -1), repeat=len(FEW))) / 2 ** len(FEW)
    got = S.sign_flip_p(_rows(spark, [*FEW, None])).first()
    assert got.observed == pytest.approx(total / len(FEW))
    assert abs(got.p_value - exact) < 5 * math.sqrt(exact * (1 - exact) / 20_000) + 1 / 20_000
    assert S.sign_flip_p(_rows(spark, [*FEW, None]).repartition(7)).first().p_value == got.p_value  # however the work is divided
    assert tuple(S.sign_flip_p(_rows(spark, [])).first()) == (None, 1.0)
    assert S.sign_flip_p(_rows(spark, [0.0, 0.0]), 50).first().p_value == 1.0


def test_sign_flips_of_many_rows(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(0.02, 1, 3000).round(3)
    got = S.sign_flip_p(_rows(spark, values.tolist()), 4000).first().p_value
    z = abs(values.sum()) / math.sqrt((values**2).sum())
    assert got == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.04)


def test_every_draw_takes_as_many_rows_as_there_are(spark):
    values, chunks = S.counted(_rows(spark, [*(np.arange(900) / 7).tolist(), *[3.5] * 5000]), "d")
    assert chunks > 1
    for split in (lambda rng, sizes, k: rng.multinomial(int(sizes.sum()), sizes / sizes.sum(), k), lambda rng, sizes, k: rng.multivariate_hypergeometric(sizes, 40, k, method="marginals")):
        shares = S._shares(values, 1000, 3, split).select("first", F.posexplode("shares")).groupBy("first", "pos").agg(F.sum("col").alias("n"))
        assert shares.count() == 1000 and shares.select("n").distinct().count() == 1
    ones = S._drawn(values, S._shares(values, 1000, 3, lambda rng, sizes, k: rng.multinomial(int(sizes.sum()), sizes / sizes.sum(), k)), 1000, 3, lambda rng, v, m, k: float(rng.multinomial(k, m / m.sum()).sum()))
    assert [tuple(r) for r in ones.select("s").distinct().collect()] == [(5900.0,)] and ones.count() == 1000


def test_bootstrap_against_theory(spark):
    two = S.bootstrap_ci(_rows(spark, [0.0, 1.0])).first()  # means 0, 0.5 and 1 with shares 1/4, 1/2 and 1/4
    assert tuple(two) == (0.0, 1.0)
    ten = S.bootstrap_ci(_rows(spark, [0.0] * 5 + [1.0] * 5)).first()  # binomial(10, 0.5) / 10
    assert tuple(ten) == (0.2, 0.8)
    values = np.random.default_rng(5).normal(2, 1, 2500).round(4)
    many = S.bootstrap_ci(_rows(spark, values.tolist()), 3000).first()
    half = 1.96 * values.std() / math.sqrt(len(values))
    assert many.low == pytest.approx(values.mean() - half, abs=0.1 * half) and many.high == pytest.approx(values.mean() + half, abs=0.1 * half)
    assert tuple(S.bootstrap_ci(_rows(spark, [])).first()) == (0.0, 0.0)


def test_permutations_against_all_subsets(spark):
    outcome = [1, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    k, mean = sum(outcome), sum(FEW) / len(FEW)
    gap = lambda chosen: abs(sum(FEW[i] for i in chosen) - k * mean)
    own = gap([i for i, y in enumerate(outcome) if y])
    subsets = list(itertools.combinations(range(len(FEW)), k))
    exact = sum(gap(c) >= own - 1e-12 for c in subsets) / len(subsets)
    rows = spark.createDataFrame([(x, y) for x, y in zip(FEW, outcome)] + [(None, 1), (1.0, None)], "x double, y int")
    got = S.correlation_p(rows, "x", "y").first()
    assert got.r == pytest.approx(np.corrcoef(FEW, outcome)[0, 1])
    assert abs(got.p_value - exact) < 5 * math.sqrt(exact * (1 - exact) / 20_000) + 1 / 20_000
    flat = S.correlation_p(rows.withColumn("x", F.lit(1.0)), "x", "y", 20).first()
    assert tuple(flat) == (0.0, 1.0) and tuple(S.correlation_p(rows.limit(0), "x", "y", 20).first()) == (0.0, 1.0)
    apart = spark.createDataFrame([(float(k), int(k >= 20)) for k in range(40)], "x double, y int")
    assert S.correlation_p(apart, "x", "y", 99).first().p_value == pytest.approx(0.01)

"""Exact quantiles against a sort, over several rounds."""

import numpy as np
import pytest

from lemmaflow.operators.quantiles import exact_quantiles

POINTS = {"low": 0.0, "p10": 0.1, "median": 0.5, "p97": 0.97, "high": 1.0}


@pytest.mark.parametrize("few", [2048, 5])
def test_quantiles_against_a_sort(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        "wide": (rng.normal(size=4001) * 10.0 ** rng.integers(-12, 12, 4001)).tolist(),
        "ties": [1.5] * 3000 + [2.5] * 10 + [-7.0] * 5,
        "two": [3.0, 4.0],
        "one": [9.25],
        "even": [float(k) for k in range(1000)],
        None: [-0.0, 0.0, 5.0, 6.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", POINTS, few).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        for name, p in POINTS.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-300)
    whole = exact_quantiles(df, [], "x", {"median": 0.5}, few).first()
    assert whole.median == pytest.approx(np.median([x for xs in groups.values() for x in xs]))
    assert exact_quantiles(df.limit(0), ["g"], "x", POINTS, few).count() == 0


def test_not_a_number_is_the_greatest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    got = exact_quantiles(df, [], "x", {"a": 0.0, "b": 1 / 3, "c": 1.0}, 1).first()
    assert got.a == float("-inf") and got.b == pytest.approx(1.0) and np.isnan(got.c)

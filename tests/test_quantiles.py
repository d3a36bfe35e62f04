"""Quantiles by selection equal those of sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import quantiles

SHARES = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "most": 1.0}


def held(groups):
    return [(k, float(v)) for k, vs in groups.items() for v in vs]


@pytest.mark.parametrize("sizes", [(10_000, 10_000), (50, 1000), (20, 60)])
def test_quantiles_of_large_small_and_equal_groups(spark, monkeypatch, sizes):
    monkeypatch.setattr(quantiles, "SORTED", sizes[0])
    monkeypatch.setattr(quantiles, "ACCURACY", sizes[1])
    r = np.random.default_rng(1)
    groups = {
        "normal": r.normal(size=3000), "spread": np.exp(r.normal(scale=60, size=2000)) * r.choice([-1, 1], size=2000), "equal": np.full(2500, 7.5),
        "ties": r.integers(0, 5, size=2000), "one": [3.0], "two": [1.0, 2.0], None: r.normal(size=400),
    }
    df = spark.createDataFrame(held(groups) + [("one", None), ("none", None)], "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        want = np.quantile(np.asarray(vs, float), list(SHARES.values()))
        assert got[k]["n"] == len(vs)
        assert np.allclose([got[k][c] for c in SHARES], want, rtol=1e-12, atol=1e-300)


def test_one_group_of_all_rows_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 100)
    df = spark.range(0, 5001).select(F.col("id").cast("double").alias("v"))
    assert tuple(quantiles.quantiles(df, [], "v", SHARES).first()) == (5001, 0.0, 500.0, 2500.0, 4500.0, 5000.0)
    assert quantiles.quantiles(df.where("v < 0"), [], "v", SHARES).count() == 0


def test_a_rank_between_two_values_that_are_there_often(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 50)
    groups = {"halves": [1.0] * 500 + [2.0] * 500, "gap": [1.0] * 400 + [1.5] * 100 + [3.0] * 500, "few": [0.0] * 450 + list(np.linspace(1, 2, 100)) + [9.0] * 450}
    df = spark.createDataFrame(held(groups), "g string, v double").repartition(3)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "v", SHARES).collect()}
    for k, vs in groups.items():
        assert np.allclose([got[k][c] for c in SHARES], np.quantile(vs, list(SHARES.values())), rtol=1e-12)


def test_a_sketch_that_misses_the_rank_costs_rounds_only(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 10_000)
    sketch, calls = quantiles.F.percentile_approx, []

    def off(column, shares, accuracy):
        # the first sketches answer for other ranks
        calls.append(1)
        return sketch(column, [0.3 + 0.1 * x for x in shares] if len(calls) < 4 else shares, accuracy)

    monkeypatch.setattr(quantiles.F, "percentile_approx", off)
    values = np.random.default_rng(2).normal(size=2000)
    df = spark.createDataFrame([(float(x),) for x in values], "v double").repartition(3)
    got = quantiles.quantiles(df, [], "v", SHARES).first()
    assert np.allclose([got[c] for c in SHARES], np.quantile(values, list(SHARES.values())), rtol=1e-12)

"""Golden forecasts and metrics of two branches over eight bins, and invariants."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import fits
from driftloom.plans import evaluate, forecast

# Branch A's shares and the totals of a worked example of eight bins; the results below belong to it.
SHARES = [0.80, 0.75, 0.70, 0.64, 0.58, 0.52, 0.46, 0.40]
TOTALS = [20, 40, 30, 80, 50, 100, 120, 90]


def counts(spark, cut, ahead=0):
    """Bins before 0 are the first ``cut`` ones; ``ahead`` empty-shaped bins follow them."""
    rows = []
    for i, (a, n) in enumerate(zip(SHARES, TOTALS)):
        rows += [(0, i - cut, "A", a * n), (0, i - cut, "B", (1 - a) * n)]
    for i in range(ahead):
        rows += [(0, len(SHARES) - cut + i, "A", 1.0), (0, len(SHARES) - cut + i, "B", 1.0)]
    return spark.createDataFrame(rows, "window_id int, bin int, branch string, n double")


GOLDEN = {
    "F-B0": [0.6, 0.6, 0.6],
    "F-B1": [0.66, 0.72, 0.78],
    "F-B2": [0.657143, 0.710067, 0.757832],
    "C-B0": [54.0, 54.0, 54.0],
    "C-B1": [62.310832, 67.294276, 71.800851],
    "C-B2": [62.251974, 67.222992, 71.721596],
}


@pytest.mark.parametrize("model", GOLDEN)
def test_golden_forecasts(spark, model):
    table = counts(spark, 8, 3)
    kinds = {"lookback": 6} if model[-1] != "0" else {}
    rows = forecast.MODELS[model](table, **kinds).where("branch = 'B'").orderBy("h").collect()
    assert [r["value"] for r in rows] == pytest.approx(GOLDEN[model], abs=1e-6)


def test_golden_metrics(spark):
    table = counts(spark, 6)
    from functools import reduce

    found = reduce(lambda a, b: a.unionByName(b), [forecast.MODELS[m](table, **({"lookback": 4} if m[-1] != "0" else {})) for m in GOLDEN])
    rows = evaluate.compared(table, found)
    got = {r["model"]: r for r in evaluate.metrics(rows).join(evaluate.top1(rows), ["model", "window_id"]).collect()}
    expected = {"F-B0": (0.09, 0.094868, 0.09, 0.004533, 0), "F-B1": (0, 0, 0, 0, 1), "F-B2": (0.003871, 0.003961, 0.003871, 0.000008, 1), "C-B1": (0.001944, 0.001944, 0.001944, 0.000002, 1)}
    for model, values in expected.items():
        r = got[model]
        assert (r["mae"], r["rmse"], r["mean_tvd"], r["mean_jsd"], r["top1_accuracy"]) == pytest.approx(values, abs=1e-6)


def test_shares_sum_to_one_and_change_point_runs(spark):
    table = counts(spark, 8, 3)
    for model in ("F-B1", "F-B2", "CPS"):
        sums = forecast.MODELS[model](table).groupBy("h").agg(F.sum("value").alias("s")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 for r in sums)


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        forecast.share_trend(counts(spark, 8, 1), lookback=1)
    with pytest.raises(ValueError):
        forecast.count_renewal(counts(spark, 8, 1), pseudo=0)


def test_fits_reach_their_optimum():
    import numpy as np

    r = np.random.default_rng(1)
    groups = [(r.normal(size=4), r.normal(size=(4, 2)), r.dirichlet(np.ones(4))) for _ in range(5)]
    b = fits.offset_multinomial(groups, 0.1)

    def loss(b):
        return -sum(float(o @ np.log(fits._softmax(a + x @ b) + 1e-12)) for a, x, o in groups) / 5 + 0.1 * float(b @ b)

    assert all(loss(b) <= loss(b + d) + 1e-12 for d in r.normal(scale=1e-3, size=(50, 2)))
    held = fits.offset_multinomial(groups, 0.1, np.array([max(b[0], 0) + 1, -np.inf]))
    assert held[0] >= max(b[0], 0) + 1 - 1e-12

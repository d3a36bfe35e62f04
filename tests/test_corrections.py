"""Corrections of forecasts on windows made by hand, whose coefficients are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import fits
from driftloom.plans import evaluate

BETA = np.array([0.8, -0.5])
COLUMNS = ("escape", "fitness")


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def made(mode, objective, windows=5, branches=3, steps=2):
    """Steps and features whose observed values are the base bent by BETA."""
    r = np.random.default_rng(4)
    rows, features, truth = [], [], {}
    for w in range(windows):
        x = r.normal(size=(branches, 2))
        x -= x.mean(0)
        features += [(w, f"b{i}", float(x[i, 0]), float(x[i, 1])) for i in range(branches)]
        base = r.dirichlet(np.ones(branches) * 5)
        centre = base @ x if mode == "relative_fitness" else 0.0
        for h in range(1, steps + 1):
            bent = (x - centre) @ BETA * (h if mode == "relative_fitness" else 1)
            value = 100 * base * np.exp(bent) if objective == "poisson" else softmax(np.log(base) + bent)
            for i in range(branches):
                rows.append((w, h, f"b{i}", float(base[i] * (100 if objective == "poisson" else 1)), float(value[i])))
                truth[w, h, f"b{i}"] = value[i]
    return rows, features, truth


def tables(spark, rows, features):
    return spark.createDataFrame(rows, "window_id int, h int, branch string, base double, observed double"), spark.createDataFrame(features, "window_id int, branch string, escape double, fitness double")


@pytest.mark.parametrize(("mode", "objective"), [("static", "distribution"), ("relative_fitness", "distribution"), ("static", "poisson")])
def test_known_coefficients_are_found_and_later_windows_predicted(spark, mode, objective):
    rows, features, truth = made(mode, objective)
    steps, known = tables(spark, rows, features)
    got = fits.corrected(steps, known, COLUMNS, objective, mode, 0.0).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["window_id"] >= 3:
            assert r["status"] == "ok" and abs(r["value"] - truth[r["window_id"], r["h"], r["branch"]]) < 1e-5 * (100 if objective == "poisson" else 1)
        else:
            assert r["status"] == "too few earlier windows" and r["value"] == r["base"]
    if mode == "static":
        for r in fits.corrected(steps, known, COLUMNS, objective, mode, 0.0, weights=True).collect():
            assert abs(r["coefficient"] / r["spread"] - BETA[COLUMNS.index(r["feature"])]) < 1e-4


def test_sets_of_features_are_judged_on_the_same_windows(spark):
    rows, features, truth = made("static", "distribution")
    steps, known = tables(spark, rows, features)
    found = fits.corrected_sets(steps, known, {"base": (), "both": COLUMNS, "one": COLUMNS[:1]}, "distribution", "static", 0.0).collect()
    error = {}
    for r in found:
        error.setdefault(r["model"], {})[r["window_id"], r["h"], r["branch"]] = abs(r["value"] - truth[r["window_id"], r["h"], r["branch"]])
    assert {k: set(v) for k, v in error.items()} == {m: {k for k in truth if k[0] >= 3} for m in ("base", "both", "one")}
    assert max(error["both"].values()) < 1e-5 < max(error["one"].values()) and max(error["base"].values()) > 0.01


def test_rolling_sets_find_known_coefficients_and_keep_floors(spark):
    r = np.random.default_rng(6)
    rows, truth = [], {}
    for w in range(6):
        x, base = r.normal(size=(4, 2)), r.dirichlet(np.ones(4) * 4)
        value = softmax(np.log(base) + x @ BETA)
        for i in range(4):
            rows.append((w, f"b{i}", float(np.log(base[i])), float(value[i]), float(x[i, 0]), float(x[i, 1])))
            truth[w, f"b{i}"] = value[i]
    df = spark.createDataFrame(rows, "window_id int, branch string, offset double, observed double, escape double, fitness double")
    sets = {"offset": (), "both": COLUMNS}
    for floors, good in ((None, True), ({"fitness": 0.0}, False)):
        got = {(x["model"], x["window_id"], x["branch"]): x["value"] for x in fits.rolling_sets(df, sets, 0.0, floors=floors).collect()}
        assert {k[1] for k in got} == {3, 4, 5}
        worst = max(abs(got["both", w, b] - v) for (w, b), v in truth.items() if w >= 3)
        assert (worst < 1e-5) == good
        assert all(abs(got["offset", w, f"b{i}"] - np.exp(rows[4 * w + i][2])) < 1e-9 for w in (3, 4, 5) for i in range(4))


def test_merged_models_are_ranked_on_the_windows_all_of_them_have(spark):
    rows = [(w, b, name, n) for w in (0, 1) for b, (x, y) in enumerate([(10, 10), (12, 8), (14, 6), (16, 4), (18, 2)], start=-3) for name, n in (("A", x), ("B", y))]
    counts = spark.createDataFrame(rows, "window_id int, bin int, branch string, n long")
    # the extra model knows window 0, and has none for window 1
    extra = spark.createDataFrame([("X", 0, 1, "A", 0.8), ("X", 0, 1, "B", 0.2), ("X", 0, 2, "A", 0.9), ("X", 0, 2, "B", 0.1)], "model string, window_id int, h int, branch string, value double")
    detail = evaluate.merged(counts, extra, ("F-B0", "C-B0"))
    got = {r["model"]: r for r in detail.collect()}
    assert set(got) == {"F-B0", "C-B0", "X"} and {r["window_id"] for r in got.values()} == {0}
    assert got["X"]["mae"] == pytest.approx(0) and got["X"]["training_input"] == "counts" and got["F-B0"]["training_input"] == "frequency"
    # the last bin before is 0.7 and 0.3: errors of 0.1 and 0.2
    assert got["F-B0"]["mae"] == pytest.approx(0.15) and got["F-B0"]["rmse"] == pytest.approx(np.sqrt((0.01 + 0.04) / 2)) and got["F-B0"]["mean_tvd"] == pytest.approx(0.15)
    ranks = {r["model"]: (r["rank"], r["window_wins"], r["windows"]) for r in evaluate.standings(detail).collect()}
    assert ranks["X"] == (1, 1, 1) and {ranks["C-B0"][0], ranks["F-B0"][0]} == {2, 3}
    assert evaluate.standings(detail).where(F.col("rank") == 1).count() == 1

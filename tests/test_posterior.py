"""Sampling against known growth, known distributions and finite differences."""

import numpy as np

from driftloom.operators import posterior


def simulated(seed, slopes, bins=20, n=60):
    r = np.random.default_rng(seed)
    t = np.arange(bins) - (bins - 1.0)
    p = posterior._shares(np.concatenate([np.linspace(-0.5, 0.5, len(slopes)), slopes]), t)
    return np.stack([r.multinomial(n, q) for q in p]).astype(float), t


def test_gradient_equals_differences():
    y, t = simulated(1, [0.1, -0.2])
    precision, b = np.repeat([0.04, 4.0], 2), np.array([0.3, -0.1, 0.05, 0.02])
    value, g = posterior.log_posterior(b, y, t, precision)
    for i in range(4):
        e = np.eye(4)[i] * 1e-5
        assert abs((posterior.log_posterior(b + e, y, t, precision)[0] - posterior.log_posterior(b - e, y, t, precision)[0]) / 2e-5 - g[i]) < 1e-3
        row = (posterior.log_posterior(b - e, y, t, precision)[1] - posterior.log_posterior(b + e, y, t, precision)[1]) / 2e-5
        assert np.allclose(row, posterior._curvature(b, y, t, precision)[i], atol=1e-3)


def test_known_slopes_are_covered_and_chains_agree():
    inside, total, rhat, ess = 0, 0, [], []
    for seed in range(40):
        slopes = np.random.default_rng(seed).normal(scale=0.1, size=2)
        y, t = simulated(100 + seed, slopes)
        chains = np.stack([posterior.sampled(y, t, [seed, c], 150, 250)[0] for c in range(2)])
        for i in range(2):
            low, high = np.quantile(chains[:, :, 2 + i], [0.025, 0.975])
            inside, total = inside + (low <= slopes[i] <= high), total + 1
            rhat.append(posterior.split_rhat(chains[:, :, 2 + i]))
            ess.append(posterior.effective(chains[:, :, 2 + i]))
    assert 0.87 <= inside / total <= 1
    assert max(rhat) < 1.1 and np.median(ess) > 150


def test_rhat_and_effective_draws_of_known_series():
    r = np.random.default_rng(2)
    free = r.normal(size=(4, 1000))
    assert posterior.split_rhat(free) < 1.01 and 3000 < posterior.effective(free) < 5500
    slow = np.zeros((4, 4000))
    for i in range(1, 4000):
        slow[:, i] = 0.9 * slow[:, i - 1] + r.normal(size=4)
    # the correlation time of this series is (1 + 0.9) / (1 - 0.9) = 19
    assert 16000 / 19 / 1.6 < posterior.effective(slow) < 16000 / 19 * 1.6
    assert posterior.split_rhat(free + np.arange(4)[:, None]) > 1.5


def test_windows_and_chains_are_tasks(spark):
    y, _ = simulated(5, [0.15], bins=16, n=200)
    rows = [(w, b - 16, name, int(y[b, i])) for w in (0, 1) for b in range(16) for i, name in enumerate(("x", "y"))] + [(2, -1, "x", 5), (2, -1, "y", 5)]
    counts = spark.createDataFrame(rows, "window_id int, bin int, branch string, n long")
    draws = posterior.posterior_draws(counts, chains=3, warm_up=100, draws=150).cache()
    assert draws.count() == 2 * 3 * 150 * 2
    found = {(r["window_id"], r["branch"]): r for r in posterior.growth_advantages(draws, 1.0).collect()}
    assert {w for w, _ in found} == {0, 1}
    for w in (0, 1):
        base = "x" if y[-3:, 0].sum() >= y[-3:, 1].sum() else "y"
        other = found[w, "y" if base == "x" else "x"]
        truth = np.exp(0.15 if base == "x" else -0.15) - 1
        assert other["low"] < truth < other["high"] and other["r_hat"] < 1.1 and other["effective_draws"] > 50 and found[w, base]["growth_advantage"] == 0
    bands = posterior.forecast_bands(draws, 4).collect()
    assert len(bands) == 2 * 4 * 2 and all(r["low"] <= r["value"] <= r["high"] for r in bands)
    assert all(abs(sum(r["value"] for r in bands if (r["window_id"], r["h"]) == (w, h)) - 1) < 1e-9 for w in (0, 1) for h in (1, 4))
    draws.unpersist()

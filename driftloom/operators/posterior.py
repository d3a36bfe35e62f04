"""Growth advantages with their posterior: a multinomial logistic model of branch counts, sampled by Hamiltonian Monte Carlo.

Share of branch v in bin t is softmax(a_v + b_v t), the base branch at 0; t is 0 at the last bin. Priors
are normal, with mean 0 and standard deviation INTERCEPT for a and SLOPE (a bin) for b. Chains start near
the maximum of the posterior and move in coordinates in which its curvature there is 1. Every window and
chain is a task; convergence is told by split R-hat and the effective number of draws over all chains.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import newton

INTERCEPT, SLOPE = 5.0, 0.5
CHAINS, WARM_UP, DRAWS = 4, 300, 500
LEAPS = (4, 16)
ACCEPTED = 0.8

_DRAWS = "window_id int, chain int, draw int, branch string, intercept double, slope double, accepted double"


def _shares(theta: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Shares of (base, others) at each t."""
    k = len(theta) // 2
    z = np.column_stack([np.zeros(len(t)), theta[:k] + t[:, None] * theta[k:]])
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def log_posterior(theta: np.ndarray, y: np.ndarray, t: np.ndarray, precision: np.ndarray) -> tuple[float, np.ndarray]:
    """Log posterior up to a constant, and its gradient."""
    p = _shares(theta, t)
    error = y[:, 1:] - y.sum(1, keepdims=True) * p[:, 1:]
    value = float((y * np.log(p + 1e-300)).sum() - 0.5 * (precision * theta * theta).sum())
    return value, np.concatenate([error.sum(0), t @ error]) - precision * theta


def _curvature(theta: np.ndarray, y: np.ndarray, t: np.ndarray, precision: np.ndarray) -> np.ndarray:
    p, k = _shares(theta, t)[:, 1:], len(theta) // 2
    w = y.sum(1)[:, None, None] * (np.einsum("tk,kl->tkl", p, np.eye(k)) - p[:, :, None] * p[:, None, :])
    zero, one, two = (np.einsum("t,tkl->kl", t**i, w) for i in range(3))
    return np.block([[zero, one], [one, two]]) + np.diag(precision)


def sampled(y: np.ndarray, t: np.ndarray, seed: list[int], warm_up: int = WARM_UP, draws: int = DRAWS) -> tuple[np.ndarray, float]:
    """Draws of (a, b) of one chain, and the share of proposals that were accepted."""
    k = y.shape[1] - 1
    precision = np.repeat([INTERCEPT**-2, SLOPE**-2], k)
    value = lambda b: -log_posterior(b, y, t, precision)[0]
    slope = lambda b: (-log_posterior(b, y, t, precision)[1], _curvature(b, y, t, precision))
    top = newton(value, slope, 2 * k)
    # theta = top + root z, so that the posterior of z is near the standard normal
    root = np.linalg.inv(np.linalg.cholesky(_curvature(top, y, t, precision))).T

    def at(z: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = log_posterior(top + root @ z, y, t, precision)
        return v, root.T @ g

    random = np.random.default_rng(seed)
    z = random.normal(size=2 * k)
    now, gradient = at(z)
    step, bar, drift = 0.5, 0.0, 0.0
    out, taken = np.empty((draws, 2 * k)), 0.0
    for i in range(warm_up + draws):
        momentum = random.normal(size=2 * k)
        y_z, y_g, y_v, m = z, gradient, now, momentum + step / 2 * gradient
        leaps = int(random.integers(*LEAPS))
        for leap in range(leaps):
            y_z = y_z + step * m
            y_v, y_g = at(y_z)
            m = m + (step if leap < leaps - 1 else step / 2) * y_g
        gain = y_v - now - (m @ m - momentum @ momentum) / 2
        chance = float(np.exp(min(0.0, gain))) if np.isfinite(gain) else 0.0
        if random.random() < chance:
            z, now, gradient = y_z, y_v, y_g
        if i < warm_up:
            # dual averaging of the step's logarithm
            drift += (ACCEPTED - chance - drift) / (i + 11)
            log_step = np.log(5.0) - np.sqrt(i + 1) / 0.05 * drift
            weight = (i + 1) ** -0.75
            bar = weight * log_step + (1 - weight) * bar
            step = float(np.exp(np.clip(log_step if i < warm_up - 1 else bar, -8, 1)))
        else:
            out[i - warm_up], taken = top + root @ z, taken + chance
    return out, taken / max(draws, 1)


def split_rhat(chains: np.ndarray) -> float:
    """Split R-hat of draws, a row for each chain."""
    half = chains.shape[1] // 2
    parts = np.concatenate([chains[:, :half], chains[:, -half:]])
    within, between = parts.var(1, ddof=1).mean(), half * parts.mean(1).var(ddof=1)
    return float(np.sqrt(((half - 1) / half * within + between / half) / within)) if within > 0 else 1.0


def effective(chains: np.ndarray) -> float:
    """Effective number of draws by the initial positive sequence of autocorrelations over all chains."""
    m, n = chains.shape
    apart = chains - chains.mean(1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(apart, size)
    cov = np.fft.irfft(f * f.conj(), size)[:, :n].mean(0) / n
    between = chains.mean(1).var(ddof=1) if m > 1 else 0.0
    whole = cov[0] + between
    if whole <= 0:
        return float(m * n)
    rho = 1 - (cov[0] - cov) / whole
    pairs = rho[: n - n % 2].reshape(-1, 2).sum(1)
    end = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
    return float(min(m * n / max(2 * pairs[:end].sum() - 1, 1e-3), m * n * np.log10(max(m * n, 10))))


def _table(group: pd.DataFrame, lookback: int) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Base and other branches, counts by bin, and times; None where the history is too short."""
    wide = group[group["bin"] < 0].pivot_table(index="bin", columns="branch", values="n", aggfunc="sum", fill_value=0).sort_index().tail(lookback)
    wide = wide.loc[:, wide.sum() > 0]
    if wide.shape[0] < 3 or wide.shape[1] < 2:
        return None
    recent = wide.tail(3).sum().drop("Unassigned", errors="ignore")
    base = recent.idxmax() if len(recent) else wide.columns[0]
    names = [base, *(c for c in wide.columns if c != base)]
    return names, wide[names].to_numpy(float), wide.index.to_numpy(float) - wide.index.max()


def _chain(warm_up: int, draws: int, lookback: int, group: pd.DataFrame) -> pd.DataFrame:
    window, chain = int(group["window_id"].iloc[0]), int(group["chain"].iloc[0])
    columns = [c.split()[0] for c in _DRAWS.split(", ")]
    held = _table(group, lookback)
    if held is None:
        return pd.DataFrame([], columns=columns)
    names, y, t = held
    theta, accepted = sampled(y, t, [window + (1 << 20), chain], warm_up, draws)
    k = len(names) - 1
    parts = [pd.DataFrame({"window_id": window, "chain": chain, "draw": np.arange(draws), "branch": names[0], "intercept": 0.0, "slope": 0.0, "accepted": accepted})]
    parts += [pd.DataFrame({"window_id": window, "chain": chain, "draw": np.arange(draws), "branch": n, "intercept": theta[:, i], "slope": theta[:, k + i], "accepted": accepted}) for i, n in enumerate(names[1:])]
    return pd.concat(parts)


def posterior_draws(counts: DataFrame, lookback: int = 26, chains: int = CHAINS, warm_up: int = WARM_UP, draws: int = DRAWS) -> DataFrame:
    """All draws of all chains of each window's history (bins below 0). Windows with under three bins or two branches have none."""
    numbered = counts.select("window_id", "bin", "branch", "n").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return numbered.groupBy("window_id", "chain").applyInPandas(partial(_chain, warm_up, draws, lookback), _DRAWS)


def growth_advantages(draws: DataFrame, tau: float = 2.7 / 14) -> DataFrame:
    """Growth advantage of each branch over the base, exp(slope tau) - 1, with a 95 % band, R-hat and effective draws."""
    schema = "window_id int, branch string, growth_advantage double, low double, high double, r_hat double, effective_draws double, accepted double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        chains = group.sort_values(["chain", "draw"])["slope"].to_numpy().reshape(group["chain"].nunique(), -1)
        gain = np.exp(chains.ravel() * tau) - 1
        low, high = np.quantile(gain, [0.025, 0.975])
        row = (int(group["window_id"].iloc[0]), group["branch"].iloc[0], float(gain.mean()), float(low), float(high), split_rhat(chains), effective(chains), float(group["accepted"].mean()))
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    return draws.groupBy("window_id", "branch").applyInPandas(run, schema)


def forecast_bands(draws: DataFrame, horizon: int) -> DataFrame:
    """Mean share and 95 % band of each branch 1 to ``horizon`` bins after the last one."""
    at = draws.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("w", F.exp(F.col("intercept") + F.col("slope") * F.col("h")))
    totals = at.groupBy("window_id", "chain", "draw", "h").agg(F.sum("w").alias("total"))
    shares = at.join(totals, ["window_id", "chain", "draw", "h"]).withColumn("share", F.col("w") / F.col("total"))
    # a list of the draws of one window, branch and step
    bands = shares.groupBy("window_id", "h", "branch").agg(F.avg("share").alias("value"), F.expr("percentile(share, array(0.025, 0.975))").alias("q"))
    return bands.select("window_id", "h", "branch", "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))

"""Fits over windows: rolling ridge, offset multinomials, corrections of a base forecast, and a logistic trend model.

Each test window is a group with the rows of all earlier windows, so all fits of a backtest run as one
job; a group has windows x branches x bins rows at most, however many records were counted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import correlations

FEATURES = ("current_share", "escape_excess", "fitness_excess")
LEAST_TRAINED = 3


def rolling(rows: DataFrame) -> DataFrame:
    """Every window's rows once as test rows and once in each later window's training rows (``test_id``, ``train``)."""
    tests = rows.select(F.col("window_id").alias("test_id")).distinct()
    pairs = rows.join(F.broadcast(tests), F.col("window_id") <= F.col("test_id"))  # a row for each window
    return pairs.withColumn("train", F.col("window_id") < F.col("test_id"))


def newton(value: Callable, slope: Callable, size: int, floor: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """Minimum of a convex function by damped Newton steps; ``slope`` gives gradient and curvature.

    Coordinates with a lower bound are held at it while the gradient pushes them below.
    """
    b = np.zeros(size)
    low = np.full(size, -np.inf) if floor is None else floor
    for _ in range(rounds):
        g, h = slope(b)
        held = (b <= low) & (g > 0)
        free = np.flatnonzero(~held)
        if not len(free) or np.abs(g[free]).max() < 1e-10:
            break
        step = np.zeros(size)
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + 1e-12 * np.eye(len(free)), g[free])
        now, scale = value(b), 1.0
        while scale > 1e-8:
            moved = np.maximum(b - scale * step, low)
            if value(moved) <= now - 1e-4 * scale * (g @ step) or scale < 1e-7:
                break
            scale /= 2
        b = moved
    return b


def standardised(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Columns less the mean and over the spread of ``by``; columns without spread keep their scale."""
    spread = by.std(axis=0)
    return (x - by.mean(axis=0)) / np.where(spread == 0, 1.0, spread)


def ridge(train: np.ndarray, target: np.ndarray, test: np.ndarray, alpha: float) -> np.ndarray:
    """Predictions of a ridge regression whose intercept has no penalty."""
    x = np.column_stack([np.ones(len(train)), standardised(train, train)])
    penalty = np.diag([0.0] + [alpha] * train.shape[1])
    beta = np.linalg.solve(x.T @ x + penalty, x.T @ target)
    return np.column_stack([np.ones(len(test)), standardised(test, train)]) @ beta


def _window_sums(rows: DataFrame, columns: tuple[str, ...], target: str) -> DataFrame:
    """Of each window, over its rows without nulls: count, sums and products of the columns and the target, less their overall means."""
    names = [*columns, target]
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    centres = rows.where(whole).agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    shifted = rows.crossJoin(F.broadcast(centres)).select("window_id", whole.alias("whole"), *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names], *[f"m_{c}" for c in names])  # one row
    sums = [F.sum(F.when(F.col("whole"), F.col(c))).alias(f"s_{c}") for c in names]
    products = [F.sum(F.when(F.col("whole"), F.col(c) * F.col(d))).alias(f"p_{c}_{d}") for i, c in enumerate(names) for d in names[i:]]
    return shifted.groupBy("window_id").agg(F.count_if("whole").alias("n"), *sums, *products, *[F.max(f"m_{c}").alias(f"m_{c}") for c in names])


def ridge_fits(features: DataFrame, columns: tuple[str, ...], target: str, alpha: float = 1.0, least: int = LEAST_TRAINED) -> DataFrame:
    """``window_id``, ``train_windows``, ``status`` and ``fit`` (intercept, then a slope for each column) of a ridge regression on all windows before.

    Windows are summed up once; running sums over the windows before are all that a fit needs, so no row is
    used twice. Columns are standardised by their training rows, the intercept has no penalty.
    """
    names = [*columns, target]
    sums = _window_sums(features.select("window_id", *names), columns, target)
    held = ["n", *[f"s_{c}" for c in names], *[f"p_{c}_{d}" for i, c in enumerate(names) for d in names[i:]]]
    before = Window.orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each window
    running = sums.select("window_id", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double").alias(c) for c in held], F.count("*").over(before).alias("train_windows"), *[f"m_{c}" for c in names])
    schema = "window_id int, train_windows int, status string, fit array<double>"
    k = len(columns)

    def solved(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                n, windows = r["n"], int(r["train_windows"])
                if windows < least or n <= k:
                    out.append((int(r["window_id"]), windows, "too few earlier windows", None))
                    continue
                mean = np.array([r[f"s_{c}"] for c in names]) / n
                cross = np.array([[r[f"p_{min(i, j, key=names.index)}_{max(i, j, key=names.index)}"] for j in names] for i in names])
                moments = cross / n - np.outer(mean, mean)
                variance = np.diag(moments)[:k]
                flat = variance <= 1e-12 * np.maximum(np.diag(cross)[:k] / n, 1e-300)
                scale = np.where(flat, 1.0, np.sqrt(np.maximum(variance, 0)))
                x = np.where(flat[:, None] | flat[None], 0.0, n * moments[:k, :k] / np.outer(scale, scale))
                y = np.where(flat, 0.0, n * moments[:k, k] / scale)
                slopes = np.linalg.solve(x + alpha * np.eye(k), y) / scale
                centre = mean + np.array([r[f"m_{c}"] for c in names])
                out.append((int(r["window_id"]), windows, "ok", [float(centre[k] - slopes @ centre[:k]), *slopes.tolist()]))
            yield pd.DataFrame(out, columns=["window_id", "train_windows", "status", "fit"])

    return running.mapInPandas(solved, schema)


def ridge_share_change(features: DataFrame, alpha: float = 1.0, least: int = LEAST_TRAINED, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Share changes predicted from the windows before; ``status`` tells why a window has none. Rows with a null column have no prediction."""
    need = ["window_id", "branch", "share_change", "current_share", "next_share", *[c for c in columns if c != "current_share"]]
    rows = features.select(*need)
    both = rows.join(ridge_fits(rows, columns, "share_change", alpha, least), "window_id")
    predicted = F.get("fit", F.lit(0))
    for i, c in enumerate(columns):
        predicted = predicted + F.get("fit", F.lit(i + 1)) * F.col(c)
    return both.select("window_id", "branch", "current_share", "next_share", "share_change", predicted.alias("predicted"), "train_windows", "status")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def offset_multinomial(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], l2: float, floor: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of softmax(offset + x b) against observed shares, groups (offset, x, observed) weighing alike."""
    size = groups[0][1].shape[1]

    def value(b: np.ndarray) -> float:
        return -sum(float(o @ np.log(_softmax(a + x @ b) + 1e-12)) for a, x, o in groups) / len(groups) + l2 * float(b @ b)

    def slope(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = 2 * l2 * b, 2 * l2 * np.eye(size)
        for a, x, o in groups:
            p = _softmax(a + x @ b)
            mean = p @ x
            g = g + (o.sum() * mean - o @ x) / len(groups)
            h = h + o.sum() * ((x * p[:, None]).T @ x - np.outer(mean, mean)) / len(groups)
        return g, h

    return newton(value, slope, size, floor)


def log_linear(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], l2: float) -> np.ndarray:
    """Coefficients of base * exp(x b) against counts, by Poisson likelihood; groups are (base, x, observed)."""
    size = groups[0][1].shape[1]

    def value(b: np.ndarray) -> float:
        total = 0.0
        for a, x, o in groups:
            m = np.maximum(a, 1e-12) * np.exp(x @ b)
            total += float((m - o * np.log(m + 1e-12)).sum())
        return total / len(groups) + l2 * float(b @ b)

    def slope(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = 2 * l2 * b, 2 * l2 * np.eye(size)
        for a, x, o in groups:
            m = np.maximum(a, 1e-12) * np.exp(x @ b)
            g, h = g + x.T @ (m - o) / len(groups), h + (x * m[:, None]).T @ x / len(groups)
        return g, h

    return newton(value, slope, size)


def corrected(steps: DataFrame, features: DataFrame, columns: tuple[str, ...], objective: str = "distribution", mode: str = "relative_fitness", l2: float = 1.0, least: int = LEAST_TRAINED, weights: bool = False) -> DataFrame:
    """A base forecast bent by branch features, fitted on the windows before.

    ``steps`` has window_id, h, branch, base (share, or count for ``poisson``) and observed; ``features``
    has window_id, branch and ``columns`` (missing ones count as 0). In ``relative_fitness`` mode features are
    centred by the base composition of the first step and their effect grows with h; in ``static`` it does not.
    With ``weights``, the coefficients by window and feature are returned instead, with each feature's mean and spread.
    """
    if objective not in ("top1", "distribution", "poisson") or mode not in ("relative_fitness", "static"):
        raise ValueError("unknown objective or mode")
    rows = steps.join(features.select("window_id", "branch", *columns), ["window_id", "branch"], "left").na.fill(0.0, list(columns))
    schema = "window_id int, h int, branch string, observed double, base double, value double, status string"
    if weights:
        schema = "window_id int, feature string, coefficient double, mean double, spread double"

    def design(frame: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[pd.DataFrame]]:
        raw, parts = [], []
        for _, window in frame.sort_values(["window_id", "h", "branch"]).groupby("window_id"):
            first = window[window["h"] == window["h"].min()]
            weights = (first["base"] / max(first["base"].sum(), 1e-12)).to_numpy()
            centre = weights @ first[list(columns)].to_numpy(float) if mode == "relative_fitness" else 0.0
            for h, step in window.groupby("h"):
                raw.append((step[list(columns)].to_numpy(float) - centre, np.full(len(step), h if mode == "relative_fitness" else 1.0)))
                parts.append(step)
        return raw, parts

    def run(group: pd.DataFrame) -> pd.DataFrame:
        test, train = group[~group["train"]], group[group["train"]]
        names = ["window_id", "h", "branch", "observed", "base"]
        if train["window_id"].nunique() < least:
            return pd.DataFrame(columns=["window_id", "feature", "coefficient", "mean", "spread"]) if weights else test[names].assign(value=test["base"], status="too few earlier windows")
        raw, parts = design(train)
        every = np.concatenate([x for x, _ in raw])
        groups = []
        for (x, h), step in zip(raw, parts):
            own, o, base = standardised(x, every) * h[:, None], step["observed"].to_numpy(float), step["base"].to_numpy(float)
            if objective == "top1":
                o = (np.arange(len(o)) == o.argmax()).astype(float)
            groups.append((base if objective == "poisson" else np.log(np.maximum(base, 1e-12)), own, o))
        b = log_linear(groups, l2) if objective == "poisson" else offset_multinomial(groups, l2)
        if weights:
            return pd.DataFrame({"window_id": int(test["window_id"].iloc[0]), "feature": columns, "coefficient": b, "mean": every.mean(0), "spread": every.std(0)})
        out = []
        for (x, h), step in zip(*design(test)):
            bent = (standardised(x, every) * h[:, None]) @ b
            base = step["base"].to_numpy(float)
            value = base * np.exp(bent) if objective == "poisson" else _softmax(np.log(np.maximum(base, 1e-12)) + bent)
            out.append(step[names].assign(value=value, status="ok"))
        return pd.concat(out)

    return rolling(rows).groupBy("test_id").applyInPandas(run, schema)


def corrected_sets(steps: DataFrame, features: DataFrame, sets: dict[str, tuple[str, ...]], objective: str = "distribution", mode: str = "relative_fitness", l2: float = 1.0, least: int = LEAST_TRAINED) -> DataFrame:
    """Corrections with several sets of features, one below the other by ``model``; an empty set leaves the base as it is.

    Windows with too few earlier ones are left out, so that all models are judged on the same ones.
    """
    before = steps.select("window_id").distinct().withColumn("earlier", F.dense_rank().over(Window.orderBy("window_id")) - 1)  # a row for each window
    tests = before.where(F.col("earlier") >= least).select("window_id")
    out = None
    for model, columns in sets.items():
        if columns:
            own = corrected(steps, features, columns, objective, mode, l2, least).select("window_id", "h", "branch", "observed", "value")
        else:
            own = steps.select("window_id", "h", "branch", "observed", F.col("base").alias("value"))
        own = own.withColumn("model", F.lit(model))
        out = own if out is None else out.unionByName(own)
    return out.join(F.broadcast(tests), "window_id", "left_semi")


def rolling_sets(rows: DataFrame, sets: dict[str, tuple[str, ...]], l2: float = 1.0, least: int = LEAST_TRAINED, floors: dict[str, float] | None = None) -> DataFrame:
    """Shares of the horizon predicted from a log-share offset and sets of features, fitted on the windows before.

    ``rows`` has window_id, branch, offset, observed (share) and the features; ``floors`` are the least
    coefficients of some. Returns model, window_id, branch, observed and value.
    """
    columns = sorted({c for own in sets.values() for c in own})
    schema = "model string, window_id int, branch string, observed double, value double"

    def groups(frame: pd.DataFrame, own: tuple[str, ...], by: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(w["offset"].to_numpy(float), standardised(w[list(own)].to_numpy(float), by), w["observed"].to_numpy(float)) for _, w in frame.groupby("window_id")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["window_id", "branch"])
        test, train = group[~group["train"]], group[group["train"]]
        if train["window_id"].nunique() < least:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        out = []
        for model, own in sets.items():
            by = train[list(own)].to_numpy(float)
            floor = np.array([(floors or {}).get(c, -np.inf) for c in own])
            b = offset_multinomial(groups(train, own, by), l2, floor) if own else np.zeros(0)
            offset, x, _ = groups(test, own, by)[0]
            out.append(test[["window_id", "branch", "observed"]].assign(model=model, value=_softmax(offset + x @ b)))
        return pd.concat(out)[[c.split()[0] for c in schema.split(", ")]]

    return rolling(rows.select("window_id", "branch", "offset", "observed", *columns)).groupBy("test_id").applyInPandas(run, schema)


def change_metrics(predictions: DataFrame, column: str = "predicted") -> DataFrame:
    """One row: rows, cutoffs, mean absolute error and rank correlation of predicted share changes, and how often the leader is met."""
    rows = predictions.where(F.col(column).isNotNull()).select("window_id", "branch", "current_share", "next_share", "share_change", F.col(column).alias("p"))
    leader = lambda c: F.min_by("branch", F.struct(-F.round(c, 9), "branch"))
    hits = rows.groupBy("window_id").agg((leader(F.col("current_share") + F.col("p")) == leader(F.col("next_share"))).alias("hit"))
    key = rows.withColumns({"k": F.lit(1), "p9": F.round("p", 9), "c9": F.round("share_change", 9)})
    related = correlations(key, ["k"], "p9", "c9").select("spearman")
    sums = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("window_id").alias("cutoffs"), F.avg(F.abs(F.col("p") - F.col("share_change"))).alias("share_change_mae"))
    return sums.crossJoin(related).crossJoin(hits.agg(F.count_if("hit").alias("top1_hits")))  # one row each


def logistic_trend(counts: DataFrame, horizon: int, lookback: int = 26, l2: float = 1e-2, tau: float = 2.7 / 14) -> DataFrame:
    """Multinomial logistic trends of branches over bins: shares with 95 % bands, and growth advantages.

    A penalised maximum-likelihood fit with a Laplace approximation, an approximation of Bayesian
    fits whose priors it does not share. The most frequent recent branch but ``Unassigned`` is the base.
    """
    schema = "window_id int, h int, branch string, value double, low double, high double, growth_advantage double, status string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        wide = group[group["bin"] < 0].pivot_table(index="bin", columns="branch", values="n", aggfunc="sum", fill_value=0).sort_index().tail(lookback)
        wide = wide.loc[:, wide.sum() > 0]
        window = int(group["window_id"].iloc[0])
        if wide.shape[0] < 3 or wide.shape[1] < 2:
            return pd.DataFrame([(window, None, None, None, None, None, None, "history is too short")], columns=[c.split()[0] for c in schema.split(", ")])
        recent = wide.tail(3).sum()
        base = recent.drop("Unassigned", errors="ignore").idxmax()
        others = [c for c in wide.columns if c != base]
        y = wide[[base, *others]].to_numpy(float)
        t = np.arange(len(y), dtype=float) - (len(y) - 1)
        k = len(others)
        n = y.sum(1)

        def shares(b: np.ndarray, at: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.zeros(len(at)), b[:k][None] + at[:, None] * b[k:][None]])
            e = np.exp(z - z.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        def value(b: np.ndarray) -> float:
            return float(-(y * np.log(shares(b, t) + 1e-300)).sum() + l2 * (b @ b))

        def slope(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = shares(b, t)[:, 1:]
            error = n[:, None] * p - y[:, 1:]
            w = n[:, None, None] * (np.einsum("tk,kl->tkl", p, np.eye(k)) - p[:, :, None] * p[:, None, :])
            blocks = [np.einsum("t,tkl->kl", t**i, w) for i in range(3)]
            return np.concatenate([error.sum(0), t @ error]) + 2 * l2 * b, np.block([[blocks[0], blocks[1]], [blocks[1], blocks[2]]]) + 2 * l2 * np.eye(2 * k)

        b = newton(value, slope, 2 * k)
        draws = np.random.default_rng(window).multivariate_normal(b, np.linalg.inv(slope(b)[1]), 400)
        at = np.arange(1, horizon + 1, dtype=float)
        middle, every = shares(b, at), np.stack([shares(d, at) for d in draws])
        low, high = np.quantile(every, 0.025, axis=0), np.quantile(every, 0.975, axis=0)
        advantage = np.concatenate([[0.0], np.exp(b[k:] * tau) - 1])
        return pd.DataFrame([(window, h + 1, c, middle[h, i], low[h, i], high[h, i], advantage[i], "ok") for h in range(horizon) for i, c in enumerate([base, *others])], columns=[c.split()[0] for c in schema.split(", ")])

    return counts.groupBy("window_id").applyInPandas(run, schema)


def collapsed(counts: DataFrame, least: int) -> DataFrame:
    """Branches with fewer than ``least`` records in the history become ``other``, if two or more others stay."""
    totals = counts.where("bin < 0").groupBy("window_id", "branch").agg(F.sum("n").alias("total"))
    stay = totals.groupBy("window_id").agg(F.count_if(F.col("total") >= least).alias("stay"))
    rows = counts.join(totals, ["window_id", "branch"], "left").join(stay, "window_id", "left")
    rare = (F.coalesce("total", F.lit(0)) < least) & (F.col("stay") >= 2)
    return rows.groupBy("window_id", "bin", F.when(rare, "other").otherwise(F.col("branch")).alias("branch")).agg(F.sum("n").alias("n"))

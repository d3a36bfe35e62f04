"""Forecasts of branch shares and counts for all windows in one plan.

Input is the long table of ``aligned_counts`` (window_id, bin, branch, n); bins before 0 are history,
the others are held out. Only non-empty bins are there, so positions count non-empty bins. Every
model returns (model, window_id, h, branch, value), h from 1 to the number of held-out bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simplex import centred, normalised, over, share, softmax, spaced

LOOKBACK = 26
GROWTH_LIMIT = 0.35
SHARE_PSEUDO = 1e-6
COUNT_PSEUDO = 0.5
LEVEL_BINS = 4
SHARE_MODELS = ("F-B0", "F-B1", "F-B2")
COUNT_MODELS = ("C-B0", "C-B1", "C-B2")


def history(counts: DataFrame) -> DataFrame:
    """History with totals, shares, and ``t``: 0 for the last bin."""
    rank = F.dense_rank().over(over("window_id").orderBy(F.desc("bin"))) - 1
    part = over("window_id", "bin")
    return counts.where("bin < 0").select("window_id", "bin", "branch", "n", F.sum("n").over(part).alias("total"), share(F.col("n"), part).alias("p"), rank.alias("t"))


def holdout(counts: DataFrame) -> DataFrame:
    """Held-out bins: ``h`` from 1, counts and shares."""
    rank = F.dense_rank().over(over("window_id").orderBy("bin"))
    part = over("window_id", "bin")
    return counts.where("bin >= 0").select("window_id", "bin", rank.alias("h"), "branch", "n", share(F.col("n"), part).alias("observed"))


def _lookback(past: DataFrame, bins: int) -> DataFrame:
    """The last ``bins`` bins, ``x`` from 0, their number, and whether each branch is seen in them."""
    last = past.where(F.col("t") < bins)
    length = F.max("t").over(over("window_id")) + 1
    return last.select("*", length.alias("length"), (length - 1 - F.col("t")).alias("x"), (F.sum("n").over(over("window_id", "branch")) > 0).alias("active"))


def _steps(counts: DataFrame) -> DataFrame:
    return holdout(counts).select("window_id", "h").distinct()


def _ahead(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each step of the window."""
    return rows.join(_steps(counts), "window_id")


def _named(rows: DataFrame, model: str, value: Column) -> DataFrame:
    return rows.select(F.lit(model).alias("model"), "window_id", "h", "branch", value.cast("double").alias("value"))


def _with_inactive(active: DataFrame, past: DataFrame) -> DataFrame:
    """Branches without a value have 0."""
    steps = active.select("window_id", "h").distinct()
    every = past.select("window_id", "branch").distinct().join(steps, "window_id")
    return every.join(active, ["window_id", "h", "branch"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def share_persistence(counts: DataFrame) -> DataFrame:
    return _named(_ahead(history(counts).where("t = 0"), counts), "F-B0", F.col("p"))


def _line(x: Column, y: Column, weight: Column) -> tuple[Column, Column]:
    """Slope and intercept of a weighted line, as aggregates; a flat line where x does not vary."""
    s, sx, sy = F.sum(weight), F.sum(weight * x), F.sum(weight * y)
    sxx, sxy = F.sum(weight * x * x), F.sum(weight * x * y)
    slope = F.coalesce(F.try_divide(s * sxy - sx * sy, s * sxx - sx * sx), F.lit(0.0))
    return slope, (sy - slope * sx) / s


def share_trend(counts: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Weighted line per branch; the weights of the squared residuals are those of the residuals squared."""
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    rows = _lookback(history(counts), lookback)
    weight = F.pow(spaced(0.5, 1.0, F.col("x"), F.col("length")), F.lit(2.0))
    slope, intercept = _line(F.col("x"), F.col("p"), weight)
    fitted = rows.groupBy("window_id", "branch").agg(slope.alias("slope"), intercept.alias("intercept"), F.max("length").alias("length"), F.max(F.when(F.col("t") == 0, F.col("p"))).alias("anchor"))
    ahead = _ahead(fitted, counts).withColumn("raw", F.col("intercept") + F.col("slope") * (F.col("length") + F.col("h") - 1))
    return _named(ahead, "F-B1", normalised(F.col("raw"), F.col("anchor"), over("window_id", "h")))


def share_selection(counts: DataFrame, lookback: int = LOOKBACK, pseudo: float = SHARE_PSEUDO, limit: float = GROWTH_LIMIT) -> DataFrame:
    """Median growth of centred log shares, continued from the last bin."""
    if lookback < 3 or pseudo <= 0 or limit <= 0:
        raise ValueError("lookback must be at least 3, pseudo and limit positive")
    past = history(counts)
    rows = _lookback(past, lookback).where("active").withColumn("z", centred(F.log(F.col("p") + pseudo), over("window_id", "bin")))
    rows = rows.withColumn("growth", F.col("z") - F.lag("z").over(over("window_id", "branch").orderBy("bin")))
    fitted = rows.groupBy("window_id", "branch").agg(F.expr("percentile(growth, 0.5)").alias("growth"), F.max(F.when(F.col("t") == 0, F.col("p"))).alias("last"))
    growth = F.greatest(F.least(F.coalesce("growth", F.lit(0.0)), F.lit(limit)), F.lit(-limit))
    ahead = _ahead(fitted, counts).withColumn("logit", F.log(F.col("last") + pseudo) + F.col("h") * growth)
    return _named(_with_inactive(ahead.select("window_id", "h", "branch", softmax(F.col("logit"), over("window_id", "h")).alias("value")), past), "F-B2", F.col("value"))


def level(past: DataFrame, bins: int = LEVEL_BINS) -> DataFrame:
    """Expected total of a bin: the median of the last ones, at least 1."""
    totals = past.where(F.col("t") < bins).select("window_id", "bin", "total").distinct()
    return totals.groupBy("window_id").agg(F.greatest(F.expr("percentile(total, 0.5)"), F.lit(1.0)).alias("level"))


def count_persistence(counts: DataFrame) -> DataFrame:
    return _named(_ahead(history(counts).where("t = 0"), counts), "C-B0", F.col("n"))


def _smoothed(past: DataFrame, lookback: int, pseudo: float) -> DataFrame:
    """Centred logs of smoothed shares of the branches seen in the lookback."""
    rows = _lookback(past, lookback).where("active")
    part = over("window_id", "bin")
    smooth = (F.col("n") + pseudo) / (F.col("total") + pseudo * F.count("*").over(part))
    return rows.withColumn("z", centred(F.log(smooth), part))


def _counted(logits: DataFrame, past: DataFrame, model: str) -> DataFrame:
    shares = logits.select("window_id", "h", "branch", softmax(F.col("logit"), over("window_id", "h")).alias("value"))
    full = _with_inactive(shares, past).join(level(past), "window_id")
    return _named(full, model, F.col("value") * F.col("level"))


def count_trend(counts: DataFrame, lookback: int = LOOKBACK, pseudo: float = COUNT_PSEUDO) -> DataFrame:
    """Lines through centred logs, bins weighted by their totals."""
    if lookback < 2 or pseudo <= 0:
        raise ValueError("lookback must be at least 2 and pseudo positive")
    past = history(counts)
    slope, intercept = _line(F.col("x"), F.col("z"), F.col("total").cast("double"))
    fitted = _smoothed(past, lookback, pseudo).groupBy("window_id", "branch").agg(slope.alias("slope"), intercept.alias("intercept"), F.max("length").alias("length"))
    ahead = _ahead(fitted, counts).withColumn("logit", F.col("intercept") + F.col("slope") * (F.col("length") + F.col("h") - 1))
    return _counted(ahead, past, "C-B1")


def count_growth(past: DataFrame, lookback: int = LOOKBACK, pseudo: float = COUNT_PSEUDO) -> DataFrame:
    """Weighted mean growth of centred logs: window_id, branch, growth (plain mean if all weights are 0)."""
    order = over("window_id", "branch").orderBy("bin")
    rows = _smoothed(past, lookback, pseudo).withColumns({"step": F.col("z") - F.lag("z").over(order), "before": F.lag("total").over(order)})
    size = F.sqrt(F.least("before", "total").cast("double"))
    weight = size * spaced(0.25, 1.0, F.col("x") - 1, F.col("length") - 1)
    rows = rows.where("step is not null").withColumn("weight", weight)
    return rows.groupBy("window_id", "branch").agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("step")), F.sum("weight")), F.avg("step")).alias("growth"))


def count_renewal(counts: DataFrame, lookback: int = LOOKBACK, pseudo: float = COUNT_PSEUDO, limit: float = GROWTH_LIMIT) -> DataFrame:
    """Weighted mean growth continued from the smoothed last bin."""
    if lookback < 3 or pseudo <= 0:
        raise ValueError("lookback must be at least 3 and pseudo positive")
    past = history(counts)
    last = _lookback(past, lookback).where("active and t = 0")
    anchor = (F.col("n") + pseudo) / F.sum(F.col("n") + pseudo).over(over("window_id"))
    fitted = last.select("window_id", "branch", anchor.alias("anchor")).join(count_growth(past, lookback, pseudo), ["window_id", "branch"], "left")
    growth = F.greatest(F.least(F.coalesce("growth", F.lit(0.0)), F.lit(limit)), F.lit(-limit))
    ahead = _ahead(fitted, counts).withColumn("logit", F.log("anchor") + F.col("h") * growth)
    return _counted(ahead, past, "C-B2")


#: Change-point forecast: bins on each side of a split, the least score of a change, ridge, decay and damping.
REGIME_BINS = 5
CHANGE_SCORE = 0.35
RIDGE = 1.0
DECAY = 0.92
STEP_LIMIT = 0.18
DAMPING = 0.85


def change_points(counts: DataFrame, lookback: int = LOOKBACK, pseudo: float = COUNT_PSEUDO) -> tuple[DataFrame, DataFrame]:
    """(slopes and last states by branch, a diagnostics row for each window) of the change-point model.

    Branches never seen in the history are left out. A split is where the mean state of the bins after
    it lies farthest from that before it; the slope is fitted on the bins from the split on.
    """
    past = history(counts)
    seen = past.withColumn("seen", F.sum("n").over(over("window_id", "branch")) > 0).where("seen")
    part = over("window_id", "bin")
    smooth = (F.col("n") + pseudo) / (F.col("total") + pseudo * F.count("*").over(part))
    state = seen.withColumn("z", centred(F.log(smooth), part)).where(F.col("t") < lookback)
    length = F.max("t").over(over("window_id")) + 1
    state = state.withColumns({"length": length, "x": length - 1 - F.col("t")})
    order = over("window_id", "branch").orderBy("x")
    moved = state.withColumns({"before": F.avg("z").over(order.rowsBetween(-REGIME_BINS, -1)), "after": F.avg("z").over(order.rowsBetween(0, REGIME_BINS - 1))})
    scores = moved.where(f"x >= {REGIME_BINS} and x <= length - {REGIME_BINS}").groupBy("window_id", "x").agg(F.round(F.sqrt(F.sum(F.pow(F.col("after") - F.col("before"), F.lit(2.0)))), 9).alias("score"))
    best = scores.groupBy("window_id").agg(F.max(F.struct("score", (-F.col("x")).alias("x"))).alias("best"))
    split = F.when(F.col("best.score") >= CHANGE_SCORE, -F.col("best.x")).otherwise(0)
    windows = state.groupBy("window_id").agg(F.max("length").alias("length")).join(best, "window_id", "left")
    windows = windows.select("window_id", "length", F.coalesce("best.score", F.lit(0.0)).alias("change_score"), F.coalesce(split, F.lit(0)).alias("split"))
    regime = state.join(windows.select("window_id", "split"), "window_id").where("x >= split")
    weight = F.pow(F.lit(DECAY), (F.col("length") - 1 - F.col("x")).cast("double"))
    regime = regime.withColumn("w", weight)
    sums = regime.groupBy("window_id", "branch").agg(
        F.sum("w").alias("s"),
        F.sum(F.col("w") * F.col("x")).alias("sx"),
        F.sum(F.col("w") * F.col("z")).alias("sz"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("w") * F.col("x") * F.col("z")).alias("sxz"),
        F.max(F.when(F.col("t") == 0, F.col("z"))).alias("last"),
        F.count("*").alias("bins"),
    )
    slope = F.when(F.col("bins") < 2, 0.0).otherwise((F.col("sxz") - F.col("sx") * F.col("sz") / F.col("s")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("s") + RIDGE))
    slopes = sums.select("window_id", "branch", "last", "bins", slope.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(over("window_id")))
    slopes = slopes.withColumn("norm", norm).withColumn("slope", F.when(F.col("norm") > STEP_LIMIT, F.col("raw") * STEP_LIMIT / F.col("norm")).otherwise(F.col("raw")))
    diagnostics = windows.join(slopes.groupBy("window_id").agg(F.least(F.max("norm"), F.lit(STEP_LIMIT)).alias("slope_norm"), F.max("bins").alias("regime_bins")), "window_id")
    return slopes.select("window_id", "branch", "last", "slope"), diagnostics


def change_point(counts: DataFrame, lookback: int = LOOKBACK, pseudo: float = COUNT_PSEUDO) -> DataFrame:
    slopes, _ = change_points(counts, lookback, pseudo)
    steps = (1 - F.pow(F.lit(DAMPING), F.col("h").cast("double"))) / (1 - DAMPING)
    ahead = _ahead(slopes, counts).withColumn("logit", F.col("last") + steps * F.col("slope"))
    shares = ahead.select("window_id", "h", "branch", softmax(F.col("logit"), over("window_id", "h")).alias("value"))
    return _named(_with_inactive(shares, history(counts)), "CPS", F.col("value"))


MODELS = {
    "F-B0": share_persistence,
    "F-B1": share_trend,
    "F-B2": share_selection,
    "C-B0": count_persistence,
    "C-B1": count_trend,
    "C-B2": count_renewal,
    "CPS": change_point,
}


def all_models(counts: DataFrame, names: tuple[str, ...] = SHARE_MODELS + COUNT_MODELS) -> DataFrame:
    """Forecasts of several models, one below the other."""
    return reduce(DataFrame.unionByName, [MODELS[n](counts) for n in names])


#: Bins whose counts make up the recent period of the trend features.
RECENT_BINS = 13
TINY = 1e-9


def trend_features(counts: DataFrame, lookback: int = LOOKBACK, recent: int = RECENT_BINS, pseudo: float = COUNT_PSEUDO) -> DataFrame:
    """Features of every branch at the cutoff: counts, log growth of counts and shares, presence, and slope.

    The recent period is the last ``recent`` bins of the lookback, the previous one those before it; a window
    without a previous period takes the last bin's shares for it.
    """
    past = history(counts)
    rows = _lookback(past, lookback)
    late, before = F.col("t") < recent, (F.col("t") >= recent) & (F.col("t") < 2 * recent)
    sums = rows.groupBy("window_id", "branch").agg(
        F.sum(F.when(F.col("t") == 0, F.col("n")).otherwise(0)).alias("current_count"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("recent_count"),
        F.sum(F.when(before, F.col("n")).otherwise(0)).alias("previous_count"),
        F.avg(F.when(late, F.when(F.col("n") > 0, 1.0).otherwise(0.0))).alias("presence"),
    )
    part = over("window_id")
    shares = {c: F.coalesce(F.try_divide(F.col(f"{c}_count").cast("double"), F.sum(f"{c}_count").over(part)), 1.0 / F.count("*").over(part)) for c in ("current", "recent")}
    sums = sums.withColumns({f"{c}_share": s for c, s in shares.items()})
    total = F.sum("previous_count").over(part)
    sums = sums.withColumn("previous_share", F.when(total > 0, F.col("previous_count") / F.when(total > 0, total)).otherwise(F.col("current_share")))
    presence = F.greatest(F.least("presence", F.lit(1 - SHARE_PSEUDO)), F.lit(SHARE_PSEUDO))
    out = sums.join(count_growth(past, lookback, pseudo), ["window_id", "branch"], "left")
    return out.select(
        "window_id",
        "branch",
        "current_count",
        "recent_count",
        "previous_count",
        F.log(F.col("current_share") + TINY).alias("log_current_share"),
        F.log1p("recent_count").alias("log_recent_count"),
        (F.log(F.col("recent_count") + pseudo) - F.log(F.col("previous_count") + pseudo)).alias("log_count_growth"),
        (F.log(F.col("recent_share") + TINY) - F.log(F.col("previous_share") + TINY)).alias("log_share_growth"),
        (F.log(presence) - F.log1p(-presence)).alias("logit_presence"),
        F.coalesce("growth", F.lit(0.0)).alias("composition_slope"),
    )

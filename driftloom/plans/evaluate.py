"""Evaluation of forecasts and rolling backtests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.simplex import divergence_term, log_factorial, normalised, over, share
from ..sources.shared import cut
from .forecast import COUNT_MODELS, SHARE_MODELS, all_models, holdout
from .windows import BIN_DAYS


def compared(counts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Observed and predicted shares of every model, window, step and branch."""
    actual = holdout(counts)
    first = actual.where("h = 1").select("window_id", "branch", F.col("observed").alias("first"))
    rows = actual.join(forecasts, ["window_id", "h", "branch"]).join(first, ["window_id", "branch"])
    part = over("model", "window_id", "h")
    return rows.select("model", "window_id", "h", "branch", "n", "observed", normalised(F.col("value"), F.col("first"), part).alias("predicted"))


def metrics(rows: DataFrame) -> DataFrame:
    """MAE, RMSE, mean total variation and Jensen-Shannon divergence of each model and window."""
    error = F.col("predicted") - F.col("observed")
    steps = rows.groupBy("model", "window_id", "h").agg(
        F.sum(F.abs(error)).alias("a"), F.sum(error * error).alias("s"), F.sum(divergence_term(F.col("observed"), F.col("predicted"))).alias("j"), F.count("*").alias("k")
    )
    return steps.groupBy("model", "window_id").agg(
        (F.sum("a") / F.sum("k")).alias("mae"), F.sqrt(F.sum("s") / F.sum("k")).alias("rmse"), F.avg(F.col("a") / 2).alias("mean_tvd"), F.avg("j").alias("mean_jsd"), F.count("*").alias("bins")
    )


def top1(rows: DataFrame) -> DataFrame:
    """Share of steps whose leading branch is predicted; ties go to the first branch by name."""
    leader = lambda c: F.row_number().over(over("model", "window_id", "h").orderBy(F.desc(F.round(c, 9)), "branch"))
    ranked = rows.withColumns({"o": leader("observed"), "p": leader("predicted")})
    return ranked.where("o = 1").groupBy("model", "window_id").agg(F.avg(F.when(F.col("p") == 1, 1.0).otherwise(0.0)).alias("top1_accuracy"))


def backtest(counts: DataFrame, models: tuple[str, ...] = SHARE_MODELS + COUNT_MODELS) -> DataFrame:
    """Metrics of all models in all windows: one plan, keyed by window.

    The counts are the small end of the data (windows x bins x branches) and every model reads them,
    so they are checkpointed, dealt by window: window functions and aggregates of a window need no shuffle then.
    """
    counts = cut(counts.repartition("window_id"))
    rows = compared(counts, all_models(counts, models))
    return metrics(rows).join(top1(rows), ["model", "window_id"])


def summary(detail: DataFrame) -> DataFrame:
    """Means over windows, spread of the total variation, and wins; ties win for all."""
    best = F.min(F.round("mean_tvd", 9)).over(over("window_id"))
    rows = detail.withColumn("win", F.when(F.round("mean_tvd", 9) == best, 1).otherwise(0))
    return rows.groupBy("model").agg(
        F.countDistinct("window_id").alias("windows"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("mean_tvd").alias("mean_tvd"),
        F.stddev_samp("mean_tvd").alias("std_tvd"),
        F.avg("mean_jsd").alias("mean_jsd"),
        F.avg("top1_accuracy").alias("top1_accuracy"),
        F.sum("win").alias("window_wins"),
    )


def wins(detail: DataFrame) -> DataFrame:
    """The models with the least total variation in each window."""
    best = F.min(F.round("mean_tvd", 9)).over(over("window_id"))
    return detail.withColumn("best", best).where(F.round("mean_tvd", 9) == F.col("best")).select("window_id", "model", "mean_tvd")


#: The least expected count in a likelihood.
LEAST_EXPECTED = 1e-12


def count_metrics(counts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE and mean Poisson negative log-likelihood of expected counts, of each model and window."""
    rows = holdout(counts).join(forecasts, ["window_id", "h", "branch"])
    expected = F.greatest("value", F.lit(LEAST_EXPECTED))
    error, seen = expected - F.col("n"), F.col("n").cast("double")
    return rows.groupBy("model", "window_id").agg(
        F.avg(F.abs(error)).alias("count_mae"), F.sqrt(F.avg(error * error)).alias("count_rmse"), F.avg(expected - seen * F.log(expected) + log_factorial(seen)).alias("mean_poisson_nll")
    )


def horizon_metrics(counts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Shares of the whole horizon, observed and predicted, compared: MAE, RMSE, TVD, JSD and whether the leader is met."""
    rows = holdout(counts).join(forecasts, ["window_id", "h", "branch"]).groupBy("model", "window_id", "branch").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    part = over("model", "window_id")
    rows = rows.select("model", "window_id", "branch", share(F.col("n"), part).alias("observed"), share(F.col("value"), part).alias("predicted"))
    error = F.col("predicted") - F.col("observed")
    leader = lambda c: F.min_by("branch", F.struct(-F.round(c, 9), "branch"))
    return rows.groupBy("model", "window_id").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (F.sum(F.abs(error)) / 2).alias("tvd"),
        F.sum(divergence_term(F.col("observed"), F.col("predicted"))).alias("jsd"), F.when(leader("observed") == leader("predicted"), 1.0).otherwise(0.0).alias("top1_accuracy"),
    )


def history_slice(dense: DataFrame, cutoff: date, horizon: int, lookback: int, days: int = BIN_DAYS) -> DataFrame:
    """Bins around a cutoff, empty ones too: ``step`` from 1 - lookback to 0 is history, from 1 to ``horizon`` ahead.

    ``dense`` has bin_start and whatever else (as of ``windows.binned``). The last bin that starts by the
    cutoff is step 0; a cutoff before the first bin, or too few bins after it, is an error.
    """
    ends = dense.agg(F.min("bin_start").alias("a"), F.max("bin_start").alias("b")).first()
    if ends["a"] is None or ends["a"] > cutoff:
        raise ValueError("the cutoff precedes the first bin")
    past = (cutoff - ends["a"]).days // days
    if (ends["b"] - ends["a"]).days // days - past < horizon:
        raise ValueError("too few bins follow the cutoff")
    step = F.floor(F.datediff("bin_start", F.lit(ends["a"])) / F.lit(days)).cast("int") - past
    return dense.withColumn("step", step).where(F.col("step").between(1 - lookback, horizon))


def single_cutoff(dense: DataFrame, cutoff: date, horizon: int, days: int = BIN_DAYS) -> DataFrame:
    """Counts of one window 0 around a cutoff, as ``aligned_counts`` has them: all history, ``horizon`` bins ahead, empty bins left out."""
    first = dense.agg(F.min("bin_start").alias("a")).first()["a"]
    if horizon <= 0 or first is None or first > cutoff:
        raise ValueError("horizon must be positive and the cutoff not before the first bin")
    past = (cutoff - first).days // days
    step = F.floor(F.datediff("bin_start", F.lit(first)) / F.lit(days)).cast("int") - past - 1
    rows = dense.select(F.lit(0).alias("window_id"), step.alias("bin"), "branch", "n").where(F.col("bin") < horizon)
    return rows.withColumn("total", F.sum("n").over(over("bin"))).where("total > 0").drop("total")


def merged(counts: DataFrame, extra: DataFrame, models: tuple[str, ...] = SHARE_MODELS + COUNT_MODELS) -> DataFrame:
    """Metrics with top-1 of the count and share models and of ``extra`` forecasts, with what each was trained on.

    Windows without ``extra`` forecasts (a fit failed there) are left out for all models.
    """
    counts = cut(counts.repartition("window_id"))
    fitted = extra.select("window_id").distinct()
    rows = compared(counts, all_models(counts, models).unionByName(extra)).join(fitted, "window_id", "left_semi")
    trained = F.when(F.col("model").startswith("F-"), "frequency").otherwise("counts")
    return metrics(rows).join(top1(rows), ["model", "window_id"]).withColumn("training_input", trained)


def standings(detail: DataFrame) -> DataFrame:
    """The summary with a rank by mean total variation; a row for each model."""
    return summary(detail).withColumn("rank", F.row_number().over(over().orderBy(F.round("mean_tvd", 9), "model")))


def compared_models(detail: DataFrame, first: str, second: str, metric: str = "mean_tvd") -> DataFrame:
    """A metric of two models side by side by window, and the second less the first."""
    wide = detail.where(F.col("model").isin(first, second)).groupBy("window_id").pivot("model", [first, second]).agg(F.first(metric))
    return wide.select("window_id", F.col(f"`{first}`").alias("one"), F.col(f"`{second}`").alias("two"), (F.col(f"`{second}`") - F.col(f"`{first}`")).alias("difference"))

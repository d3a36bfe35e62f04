"""Score signals around windows: branch statistics, shares before and after, leaders and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.simplex import over
from .quantiles import quantiles


def _in_range(rows: DataFrame, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Rows inside each window's range. Windows are a small table, a row for each cutoff."""
    return rows.join(F.broadcast(spans.select("window_id", first, last)), F.col("collection_date").between(F.col(first), F.col(last)))


def branch_counts(records: DataFrame, spans: DataFrame, first: str, last: str, name: str) -> DataFrame:
    by_day = records.groupBy("collection_date", "branch").agg(F.count("*").alias("n"))
    return _in_range(by_day, spans, first, last).groupBy("window_id", "branch").agg(F.sum("n").alias(name))


def score_signal(records: DataFrame, spans: DataFrame, least: int = 10) -> DataFrame:
    """Counts, shares and score statistics of every branch in the half-year before a window, and its share in it.

    ``records`` has collection_date, branch and score (null: not scored). Statistics of fewer than
    ``least`` scored records are null.
    """
    before = branch_counts(records, spans, "recent_start", "recent_end", "previous_count")
    after = branch_counts(records, spans, "target_start", "target_end", "next_count")
    own = _in_range(records.where("score is not null"), spans, "recent_start", "recent_end")
    stats = own.groupBy("window_id", "branch").agg(F.count("score").alias("scored"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    stats = stats.join(quantiles(own, ["window_id", "branch"], "score", {"median_score": 0.5}).drop("n"), ["window_id", "branch"], "left")
    rows = before.join(after, ["window_id", "branch"], "full_outer").join(stats, ["window_id", "branch"], "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("previous_count", "next_count")})
    part = over("window_id")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(part), F.lit(1))
    rows = rows.withColumns({"previous_share": share("previous_count"), "next_share": share("next_count")})
    masked = {c: F.when(F.col("scored") >= least, F.col(c)) for c in ("mean_score", "median_score", "max_score")}
    return rows.withColumns(masked | {"share_change": F.col("next_share") - F.col("previous_share")})


def leaders(rows: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """The leading branch of each window by each column (True: lowest leads); nulls don't lead, ties by name."""
    out = None
    for column, lowest in columns.items():
        key = F.col(column) if lowest else -F.col(column)
        own = rows.where(F.col(column).isNotNull()).groupBy("window_id").agg(F.min_by("branch", F.struct(F.round(key, 9), F.col("branch"))).alias(f"{'low' if lowest else 'high'}_{column}"))
        out = own if out is None else out.join(own, "window_id", "full_outer")
    return out


def distance_signal(scored: DataFrame, records: DataFrame, spans: DataFrame, least: int = 10, baseline: str = "annual") -> DataFrame:
    """Mean and median distance of every branch, its excess over all of the year (or the recent half-year) and over the half-year before."""
    if baseline not in ("annual", "recent"):
        raise ValueError("baseline is 'annual' or 'recent'")
    recent = _in_range(scored, spans, "recent_start", "recent_end")
    stats = recent.groupBy("window_id", "branch").agg(F.count("distance").alias("scored"), F.avg("distance").alias("mean_distance"))
    stats = stats.join(quantiles(recent, ["window_id", "branch"], "distance", {"median_distance": 0.5}).drop("n"), ["window_id", "branch"], "left")
    whole = _in_range(scored, spans, f"{baseline}_start", f"{baseline}_end").groupBy("window_id").agg(F.avg("distance").alias("overall"))
    earlier = _in_range(scored, spans, "previous_half_start", "previous_half_end").groupBy("window_id").agg(F.avg("distance").alias("earlier"))
    after = branch_counts(records, spans, "target_start", "target_end", "next_count")
    rows = stats.where(F.col("scored") >= least).join(whole, "window_id").join(earlier, "window_id", "left").join(after, ["window_id", "branch"], "left")
    return rows.select("window_id", "branch", "scored", "mean_distance", "median_distance", (F.col("mean_distance") - F.col("overall")).alias("excess"), (F.col("mean_distance") - F.col("earlier")).alias("excess_previous"), F.coalesce("next_count", F.lit(0)).alias("next_count"))


def branch_features(scored: DataFrame, records: DataFrame, spans: DataFrame, least: int = 10) -> DataFrame:
    """Features of every branch at a cutoff: sizes, means, shares before and after, and excesses over the year."""
    recent = _in_range(scored, spans, "recent_start", "recent_end")
    stats = recent.groupBy("window_id", "branch").agg(F.count("*").alias("scored_sequences"), F.avg("distance").alias("mean_distance"), F.avg("score").alias("mean_fitness"))
    year = _in_range(scored, spans, "annual_start", "annual_end").groupBy("window_id").agg(F.avg("distance").alias("year_distance"), F.avg("score").alias("year_fitness"))
    shares = []
    for first, last, name in (("recent_start", "recent_end", "current_share"), ("target_start", "target_end", "next_share")):
        counts = branch_counts(records, spans, first, last, "n")
        shares.append(counts.select("window_id", "branch", (F.col("n") / F.greatest(F.sum("n").over(over("window_id")), F.lit(1))).alias(name)))
    rows = stats.where(F.col("scored_sequences") >= least).join(year, "window_id")
    for own in shares:
        rows = rows.join(own, ["window_id", "branch"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("current_share", "next_share")})
    return rows.select(
        "window_id", "branch", "scored_sequences", "mean_distance", "mean_fitness", "current_share", "next_share", (F.col("next_share") - F.col("current_share")).alias("share_change"),
        (F.col("mean_distance") - F.col("year_distance")).alias("escape_excess"), (F.col("mean_fitness") - F.col("year_fitness")).alias("fitness_excess"),
    )


def bridge(start: DataFrame, end: DataFrame, steps: int) -> DataFrame:
    """Shares on the straight way between two compositions (branch, share), at 1 to ``steps``."""
    both = start.select("branch", F.col("share").alias("a")).join(end.select("branch", F.col("share").alias("b")), "branch", "full_outer").na.fill(0.0, ["a", "b"])
    rows = both.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.select("h", "branch", (F.col("a") + (F.col("b") - F.col("a")) * F.col("h") / steps).alias("share"))


def gated(features: DataFrame, threshold: float) -> DataFrame:
    """Fitness excess only of branches farther than a threshold, and the product of positive escape and fitness."""
    return features.withColumns({
        "gated_fitness_excess": F.when(F.col("mean_distance") > threshold, F.col("fitness_excess")).otherwise(0.0),
        "escape_fitness_interaction": F.greatest("escape_excess", F.lit(0.0)) * F.col("fitness_excess"),
    })


def with_features(rows: DataFrame, features: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with a branch's features, missing ones 0, and whether it has any (``bio_available``)."""
    held = features.select("window_id", "branch", *columns).withColumn("bio_available", F.lit(1.0))
    return rows.join(held, ["window_id", "branch"], "left").na.fill(0.0, [*columns, "bio_available"])


def signal_overview(correlations: DataFrame, leaders: DataFrame, truth: str, guesses: tuple[str, ...]) -> DataFrame:
    """One row: mean correlations over the windows that have one, and how often each guess names the true leader."""
    means = correlations.agg(F.avg("pearson").alias("mean_pearson"), F.avg("spearman").alias("mean_spearman"), F.count("*").alias("windows"))
    hits = leaders.agg(*[F.count_if(F.col(g) == F.col(truth)).alias(f"{g}_hits") for g in guesses])
    return means.crossJoin(hits)  # one row each


def without_windows(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows of the windows that aren't excluded."""
    return rows.join(excluded.select("window_id").distinct(), "window_id", "left_anti")


def window_overview(counts: DataFrame) -> DataFrame:
    """Non-empty bins of the history and of the holdout of every window, and the records held out."""
    bins = lambda c: F.count_distinct(F.when(c, F.col("bin")))
    return counts.where("n > 0").groupBy("window_id").agg(bins(F.col("bin") < 0).alias("history_bins"), bins(F.col("bin") >= 0).alias("holdout_bins"), F.sum(F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)).alias("holdout_records"))

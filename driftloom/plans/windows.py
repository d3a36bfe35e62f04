"""Time bins, half-year windows and cutoffs. Windows are a small table; every plan runs on all of them at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIN_DAYS = 14


def bin_index(day: Column, origin: Column, days: int = BIN_DAYS) -> Column:
    """Which bin a day is in, also before the origin."""
    return F.floor(F.datediff(day, origin) / F.lit(days)).cast("int")


def bin_start(index: Column, origin: Column, days: int = BIN_DAYS) -> Column:
    return F.date_add(origin, (index * days).cast("int"))


def half_years(spark: SparkSession, first: date, count: int) -> DataFrame:
    """``window_id``, ``start`` and ``end`` of half-years in a row."""
    rows = spark.range(count).select(F.col("id").cast("int").alias("window_id"))
    start = F.add_months(F.lit(first), (F.col("window_id") * 6).cast("int"))
    return rows.select("window_id", start.alias("start"), F.date_sub(F.add_months(start, 6), 1).alias("end"))


def given(spark: SparkSession, starts: list[date]) -> DataFrame:
    """Half-years that begin on given days: each day once, in order."""
    rows = list(enumerate(sorted(set(starts))))
    table = spark.createDataFrame(rows, "window_id int, start date")
    return table.withColumn("end", F.date_sub(F.add_months("start", 6), 1))


def cutoffs(windows: DataFrame) -> DataFrame:
    """Ranges around each window: recent half-year, past year, the half-year before, and the target."""
    start = F.col("start")
    return windows.select(
        "window_id",
        F.date_sub(start, 1).alias("forecast_cutoff"),
        F.add_months(start, -6).alias("recent_start"),
        F.date_sub(start, 1).alias("recent_end"),
        F.add_months(start, -12).alias("annual_start"),
        F.date_sub(start, 1).alias("annual_end"),
        F.add_months(start, -12).alias("previous_half_start"),
        F.date_sub(F.add_months(start, -6), 1).alias("previous_half_end"),
        start.alias("target_start"),
        F.col("end").alias("target_end"),
    )


def binned(records: DataFrame, first: date, last: date | None = None, days: int = BIN_DAYS) -> DataFrame:
    """Dense bin x branch counts and shares of records (``collection_date``, ``branch``).

    All bins from ``first`` to that of the last record are there, also empty ones, whose shares are 0.
    Branches are numbered by their first day, ``Unassigned`` first of all, ties by name.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    if last is not None and first > last:
        raise ValueError("first must not be after last")
    inside = records.where(F.col("collection_date") >= F.lit(first))
    if last is not None:
        inside = inside.where(F.col("collection_date") <= F.lit(last))
    by_day = inside.groupBy("collection_date", "branch").agg(F.count("*").alias("n"))
    origin = F.lit(first)
    cells = by_day.groupBy(bin_index(F.col("collection_date"), origin, days).alias("bin"), "branch").agg(F.sum("n").alias("n"), F.min("collection_date").alias("seen"))
    order = Window.orderBy(F.when(F.col("branch") == "Unassigned", 0).otherwise(1), "first_seen", "branch")
    branches = cells.groupBy("branch").agg(F.min("seen").alias("first_seen")).withColumn("branch_pos", F.row_number().over(order))
    ends = cells.agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    bins = ends.select(F.explode(F.sequence("low", "high")).alias("bin"))
    grid = bins.crossJoin(branches)  # as many rows as the result has: bins x branches
    full = grid.join(cells.select("bin", "branch", "n"), ["bin", "branch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("bin"))
    return full.select(
        bin_start(F.col("bin"), origin, days).alias("bin_start"), "branch", "branch_pos", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)).alias("share")
    )


def aligned_counts(records: DataFrame, windows: DataFrame, train_start: date, days: int = BIN_DAYS) -> DataFrame:
    """Counts of every window's non-empty bins x its branches: window_id, bin, branch, n.

    Bins start at the window and run backwards to ``train_start``; forward there are only complete
    ones. Records are counted by day first, so the join with the windows is small at any size.
    """
    horizon = F.floor((F.datediff("end", "start") + 1) / F.lit(days)).cast("int")
    spans = windows.select("window_id", F.col("start").alias("origin"), horizon.alias("horizon"))
    spans = spans.withColumn("last", F.date_add("origin", (F.col("horizon") * days - 1).cast("int")))
    by_day = records.where(F.col("collection_date") >= F.lit(train_start)).groupBy("collection_date", "branch").agg(F.count("*").alias("n"))
    hits = by_day.join(F.broadcast(spans), F.col("collection_date") <= F.col("last"))  # a row for each window
    cells = hits.groupBy("window_id", bin_index(F.col("collection_date"), F.col("origin"), days).alias("bin"), "branch").agg(F.sum("n").alias("n"))
    grid = cells.select("window_id", "bin").distinct().join(cells.select("window_id", "branch").distinct(), "window_id")
    return grid.join(cells, ["window_id", "bin", "branch"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

"""Score tables: pending work, completeness, ranks, summaries, weighted statistics and correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simplex import over
from ..sources.shared import folder
from .quantiles import quantiles


class Scorer(Protocol):
    """Scores a batch of different sequences."""

    def __call__(self, sequences: pd.Series) -> pd.Series: ...


def surrogate(sequences: pd.Series) -> pd.Series:
    """A stand-in score without a model: share of hydrophobic letters, 0 for an empty sequence."""
    upper = sequences.str.upper()
    return (upper.str.count("[AVILMFWY]") / upper.str.len().where(upper.str.len() > 0)).fillna(0.0)


def scored(rows: DataFrame, scorer: Callable[[pd.Series], pd.Series] = surrogate) -> DataFrame:
    """``sequence`` and ``score``: each different sequence is scored once, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=scorer(batch["sequence"]).astype(float))

    return rows.select("sequence").where("sequence is not null").distinct().mapInPandas(run, "sequence string, score double")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no result has yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def seeded(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows whose key it does not have; of equal new keys one is taken."""
    return table.unionByName(pending(new.dropDuplicates(keys), table, keys))


def completeness(rows: DataFrame) -> DataFrame:
    """One row: records, completed, sources and invalid scores (not finite)."""
    bad = F.isnan("score") | (F.abs("score") == float("inf"))
    return rows.agg(F.count("*").alias("records"), F.count("score").alias("completed"), F.countDistinct("source").alias("sources"), F.count_if(bad).alias("invalid"))


def require_complete(rows: DataFrame) -> None:
    """Refuse a table with missing or invalid scores."""
    r = completeness(rows).first()
    if r["completed"] < r["records"] or r["invalid"]:
        raise ValueError(f"{r['records'] - r['completed']} scores are missing and {r['invalid']} invalid")


def by_year_and_clade(rows: DataFrame) -> DataFrame:
    """Counts, means and ranges by year, by clade and by both, in one pass."""
    base = rows.where("year is not null").withColumn("clade", F.coalesce("clade", F.lit("unassigned")))
    sets = base.groupingSets([[F.col("year")], [F.col("year"), F.col("clade")], [F.col("clade")]], F.col("year"), F.col("clade"))
    return sets.agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.min("year_value").alias("first_year"), F.max("year_value").alias("last_year")
    )


def ranked(rows: DataFrame, key: str, value: str, last: str) -> DataFrame:
    """Every row with its ``rank`` in ``key`` by falling ``value``, then ``last``, the unique key.

    Rows are written in sorted ranges, numbered inside them, and moved by the counts of the ranges before,
    so that no key is sorted in one task.
    """
    spark, order = rows.sparkSession, [F.col(key), F.desc(value), F.col(last)]
    sorted_, path = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), folder(rows.sparkSession, "ranked")
    sorted_.write.parquet(path)
    sorted_ = spark.read.schema(sorted_.schema).parquet(path)
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range and key, at most the ranges and keys together
    counts = sorted_.groupBy(key, "part").agg(F.count("*").alias("n")).select(F.col(key).alias("k"), F.col("part").alias("at"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", key).orderBy(F.desc(value), last))
    numbered = sorted_.withColumn("own", own).join(counts, F.col(key).eqNullSafe(F.col("k")) & (F.col("part") == F.col("at")))
    return numbered.withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "k", "at", "before")


def weighted_summary(pairs: DataFrame, keys: list[str], value: str = "distance", weight: str = "weight", digits: int | None = None) -> DataFrame:
    """Weighted mean and lower empirical quantiles, range and number of references of each query.

    With ``digits``, for values of so many digits and whole weights, sums are exact and the mean is rounded once.
    """
    part = Window.partitionBy(*keys)
    ordered = part.orderBy(value, "reference_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.withColumns({"cum": F.sum(weight).over(ordered), "total": F.sum(weight).over(part)})
    quantile = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total") - 1e-12, F.col(value)))
    mean = F.sum(F.col(weight) * F.col(value)) / F.sum(weight)
    if digits is not None:
        units = F.sum(F.col(weight).cast("long") * F.round(F.col(value) * 10**digits).cast("long"))
        whole = F.sum(F.col(weight).cast("long"))
        mean = F.call_function("div", 2 * units + whole, 2 * whole) / float(10**digits)
    return rows.groupBy(*keys).agg(
        mean.alias("mean"),
        quantile(0.5).alias("p50"),
        quantile(0.1).alias("p10"),
        quantile(0.9).alias("p90"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.count("*").alias("panel_size"),
    )


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns as an aggregate; null without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-15, spread)))


def with_ranks(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Average ranks ``rx`` and ``ry`` of the rows that have both values."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str) -> Column:
        return F.rank().over(over(*keys).orderBy(c)) + (F.count("*").over(over(*keys, c)) - 1) / 2.0

    return both.withColumns({"rx": rank(x), "ry": rank(y)})


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of each key; null for fewer than 3 pairs or no spread."""
    return with_ranks(rows, keys, x, y).groupBy(*keys).agg(pearson(x, y).alias("pearson"), pearson("rx", "ry").alias("spearman"), F.count("*").alias("pairs"))


def overview(rows: DataFrame, *numbers: str, time: str) -> DataFrame:
    """One row: count, least, most and mean of each number, first and last time."""
    parts = [F.count("*").alias("n")]
    for c in numbers:
        parts += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    return rows.agg(*parts, F.min(time).alias(f"first_{time}"), F.max(time).alias(f"last_{time}"))


def once_each(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of repeated scores of a key."""
    return rows.groupBy(*keys).agg(F.avg(value).alias(value))


def coverage(rows: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """Of each cutoff: summaries, different queries, panel size, mean and lower and upper decile of a value, and whether all wanted ones are there.

    ``wanted`` has window_id and ``instances``; cutoffs that it lacks are left out.
    """
    sums = rows.groupBy("window_id").agg(
        F.count("*").alias("summaries"), F.countDistinct("query_id").alias("queries"), F.min("panel_size").alias("panel_size"), F.avg(value).alias("mean"), F.max("scored_at").alias("scored_at")
    )
    sums = sums.join(quantiles(rows, ["window_id"], value, {"p10": 0.1, "p90": 0.9}).drop("n"), "window_id", "left")
    return sums.join(wanted, "window_id").withColumn("complete", F.col("summaries") == F.col("instances"))


def registry(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each query once (its first row by record_index), with the embedding it may reuse, or one of its own to be made.

    ``known`` has sequence and embedding_id; the first one by name serves a sequence.
    """
    first = rows.groupBy("query_id").agg(F.min_by(F.struct("record_index", "sequence"), "record_index").alias("r")).select("query_id", "r.*")
    held = known.groupBy("sequence").agg(F.min("embedding_id").alias("held"))
    source = F.when(F.col("held").isNotNull(), "reused").otherwise("new")
    return first.join(held, "sequence", "left").select("query_id", "record_index", F.coalesce("held", "query_id").alias("embedding_id"), source.alias("embedding_source"))


def require_same_parameters(stored: dict, wanted: dict) -> None:
    """Refuse to go on with a score table that other parameters made."""
    if changed := sorted(k for k in stored.keys() | wanted.keys() if stored.get(k) != wanted.get(k)):
        raise ValueError(f"the table was made with other values of {', '.join(changed)}")


def annual_work(instances: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Queries of the year before each cutoff, each once with its last instance (by date, then record_index)."""
    spans = cutoffs.select("window_id", "annual_start", "annual_end")
    hits = instances.join(F.broadcast(spans), F.col("collection_date").between(F.col("annual_start"), F.col("annual_end")))  # a row for each window
    last = F.max(F.struct("collection_date", "record_index")).alias("last")
    return hits.groupBy("window_id", "query_id").agg(last, F.count("*").alias("n")).select("window_id", "query_id", "last.*", "n")

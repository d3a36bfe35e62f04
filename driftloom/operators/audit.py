"""Data audits: counters by status, top values, metric summaries, lineages and changes between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import error_class, label_status, stripped
from ..functions.simplex import over
from .quantiles import quantiles


def long_statuses(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each field of each record: field, value, status."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), stripped(F.coalesce(F.col(c), F.lit(""))).alias("value"), label_status(F.col(c)).alias("status")) for c in fields]))
    return rows.select(pairs.alias("p")).select("p.*")


def status_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    return long_statuses(rows, fields).groupBy("field", "status").agg(F.count("*").alias("n"))


def status_by(rows: DataFrame, field: str, *dimensions: str) -> DataFrame:
    """Counts of a field's statuses by each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions]))
    return rows.select(label_status(F.col(field)).alias("status"), pairs.alias("p")).groupBy("p.dimension", "p.value", "status").agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, fields: list[str], k: int = 20) -> DataFrame:
    """The most frequent values of each field and status, ties by value."""
    counts = long_statuses(rows, fields).groupBy("field", "status", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(over("field", "status").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def metric_summary(rows: DataFrame, field: str, metric: str) -> DataFrame:
    """Count, median and mean of a metric by status, to 6 digits."""
    own = rows.select(label_status(F.col(field)).alias("status"), F.col(metric).alias("value"))
    sums = own.groupBy("status").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    found = quantiles(own, ["status"], "value", {"median": 0.5}).select("status", F.round("median", 6).alias("median"))
    return sums.join(found, "status", "left").select("status", "n", "median", "mean")


def lineages(rows: DataFrame, value: str, field: str, k: int = 20) -> DataFrame:
    """The largest lineages with their share of records that aren't assigned."""
    missing = F.when(label_status(F.col(field)) != "assigned", 1).otherwise(0)
    counts = rows.groupBy(F.col(value).alias("lineage")).agg(F.count("*").alias("n"), F.sum(missing).alias("not_assigned"))
    rated = counts.withColumn("rate", F.coalesce(F.round(F.try_divide("not_assigned", "n"), 6), F.lit(0.0)))
    return rated.orderBy(F.desc("n"), "lineage").limit(k)


def error_counts(rows: DataFrame, message: str) -> DataFrame:
    """Messages that aren't blank by class."""
    some = rows.where(F.trim(F.coalesce(F.col(message), F.lit(""))) != "")
    return some.groupBy(error_class(F.col(message)).alias("category")).agg(F.count("*").alias("n"))


def run_changes(runs: DataFrame) -> DataFrame:
    """Status changes between every two runs of a folder: overlap, only left, only right.

    ``runs`` has folder, run, name, line, status; a name that occurs twice in a run has its last status.
    Runs of a folder are few, so a name meets few others; the join is on folder and name.
    """
    last = runs.groupBy("folder", "run", "name").agg(F.max_by("status", "line").alias("status"))
    names = last.select("folder", "run").distinct()
    pairs = names.alias("a").join(names.alias("b"), "folder").where("a.run < b.run").select("folder", F.col("a.run").alias("left_run"), F.col("b.run").alias("right_run"))
    sides = []
    for side in ("left", "right"):
        own = last.select("folder", F.col("run").alias(f"{side}_run"), "name", F.col("status").alias(f"{side}_status"))
        sides.append(pairs.join(own, ["folder", f"{side}_run"]))
    both = sides[0].join(sides[1], ["folder", "left_run", "right_run", "name"], "full_outer")
    return both.groupBy("folder", "left_run", "right_run", F.coalesce("left_status", F.lit("absent")).alias("left_status"), F.coalesce("right_status", F.lit("absent")).alias("right_status")).agg(F.count("*").alias("n"))


def ragged_lines(lines: DataFrame) -> DataFrame:
    """Lines of a tab-separated text whose number of cells isn't the header's, by file."""
    sized = lines.withColumn("cells", F.size(F.split("value", "\t")))
    header = sized.where("line = 0").select("file", F.col("cells").alias("expected"))
    return sized.where("line > 0").join(header, "file").groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if(F.col("cells") != F.col("expected")).alias("ragged_rows"))


def repeated_names(rows: DataFrame, name: str) -> DataFrame:
    """Rows beyond the first of their name: one row."""
    counts = rows.groupBy(name).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("duplicate_rows"), F.max("c").alias("largest"))



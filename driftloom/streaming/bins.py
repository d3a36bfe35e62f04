"""Bin counts over streams, with late records up to a watermark, and idempotent score ingestion."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import ScoreStore


def stream_bins(records: DataFrame, time: str, branch: str, first: date, days: int = 14, late: str = "2 days", key: str | None = None) -> DataFrame:
    """Counts of each tumbling bin and branch of a stream; bins are those of the batch plan from ``first``.

    With ``key``, records that come twice within the watermark count once.
    """
    shift = (first - date(1970, 1, 1)).days % days
    rows = records.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key])
    bins = F.window("event_time", f"{days} days", f"{days} days", f"{shift} days")
    counts = rows.groupBy(bins.alias("w"), F.col(branch).alias("branch")).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("w.start").alias("bin_start"), "branch", "n")


def ingest_scores(scores: DataFrame, store: ScoreStore) -> DataStreamWriter:
    """Merge each micro-batch into a score table by key: a repeated batch changes nothing, and no other key is touched."""

    def put(batch: DataFrame, _: int) -> None:
        store.upsert(batch)

    return scores.writeStream.foreachBatch(put)

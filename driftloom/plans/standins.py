"""Observation, header and sequence views over the driver's tables, for the registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import upper
from . import windows

TRAIN_START = date(1995, 1, 1)
FIRST_WINDOW = date(1997, 1, 1)
WINDOWS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated observations with three raw label columns, a coarse branch and a score."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        key.alias("obs_id"),
        F.to_date("o_orderdate").alias("collection_date"),
        F.when(key % 11 == 0, "").when(key % 13 == 0, "Unassigned").otherwise(F.col("n_name")).alias("subclade"),
        F.when(key % 7 == 0, "unknown").otherwise(F.col("r_name")).alias("clade"),
        F.col("c_mktsegment").alias("legacy"),
        F.col("o_orderpriority").alias("coarse"),
        F.col("o_totalprice").alias("score"),
    )


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations by their coarse branch; no other table is needed for it."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.to_date("o_orderdate").alias("collection_date"), F.col("o_orderpriority").alias("branch"), F.col("o_totalprice").alias("score")
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe headers with an accession, labels, a date and a later second date."""
    o = observations(spark, sf_dir)
    acc = F.concat(F.lit("EPI_ISL_"), F.col("obs_id").cast("string"))
    day = F.when(F.col("obs_id") % 17 == 0, "2020-13-45").when(F.col("obs_id") % 19 == 0, "").otherwise(F.date_format("collection_date", "yyyy-MM-dd"))
    name = F.concat(F.lit("A/"), F.col("legacy"), F.lit("/"), F.col("obs_id").cast("string"), F.lit("/"), F.year("collection_date").cast("string"))
    header = F.concat_ws("|", name, acc, F.lit("H1N1"), F.col("legacy"), F.col("clade"), F.col("subclade"), day, F.date_format(F.date_add("collection_date", 30), "yyyy-MM-dd"))
    return o.select("obs_id", header.alias("header"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequence records."""
    header = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, "|NA|").otherwise("|HA|"), F.col("lang"), F.lit("|"), F.col("source"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_index"), header.alias("header"), upper(F.col("text")).alias("sequence"))


def fixed_sequences(spark: SparkSession, sf_dir: str, length: int = 64) -> DataFrame:
    """Sequences of one length: the letters A to Z of each document in pieces in a row, a last shorter rest left out."""
    letters = F.regexp_replace(upper(F.col("text")), "[^A-Z]+", "")
    # all pieces in one go through the letters: substrings would each begin at the first letter, and a row for each piece hold them all
    pieces = F.regexp_extract_all(letters, F.lit(f"[A-Z]{{{length}}}"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_index"), "lang", F.posexplode(pieces).alias("piece", "sequence"))
    return rows.select("record_index", "piece", "lang", "sequence")


def letter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of capital letters, all of each text."""
    rows = sequences(spark, sf_dir)
    return rows.select("record_index", "header", F.regexp_replace("sequence", "[^A-Z]", "").alias("sequence"))


def half_years(spark: SparkSession) -> DataFrame:
    return windows.half_years(spark, FIRST_WINDOW, WINDOWS)


def cutoffs(spark: SparkSession) -> DataFrame:
    return windows.cutoffs(half_years(spark))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.aligned_counts(coarse(spark, sf_dir), half_years(spark), TRAIN_START)

"""Annotation tables, score imports, wide exports, and manifests."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import branch_label, first_date
from ..operators.joins import require_columns
from .lines import numbered

BRANCH_COLUMNS = {"subclade": "subclade", "clade": "clade", "legacy": "legacy-clade"}


def read_annotations(spark: SparkSession, path: str, mode: str = "nextclade", recursive: bool = False) -> DataFrame:
    """Annotation tables (tab-separated, with header) as strings, with ``collection_date`` and ``branch``.

    ``seqName`` and one branch column at least must be there; only these columns are read.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", recursive)
    rows = (reader.option("pathGlobFilter", "*.tsv") if recursive else reader).csv(path)
    require_columns(rows, "seqName")
    there = {k: v for k, v in BRANCH_COLUMNS.items() if v in rows.columns}
    if not there:
        raise ValueError("no branch column: " + ", ".join(BRANCH_COLUMNS.values()))
    rows = rows.select("seqName", *[F.col(f"`{v}`").alias(k) for k, v in there.items()])
    for k in BRANCH_COLUMNS.keys() - there.keys():
        rows = rows.withColumn(k, F.lit(None).cast("string"))
    return rows.withColumns({"collection_date": first_date(F.col("seqName")), "branch": branch_label(mode)})


def read_lines(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """Lines of all tables under a path with their file and place: ``line`` 0 is the header of a file, read by many tasks."""
    rows = numbered(spark, path, glob=glob)
    text = F.when(F.col("line") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return rows.select("file", "line", text.alias("value"))


def read_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Some columns (name to type) of comma-separated tables with a header; others are not parsed. Values that don't fit are null."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    require_columns(rows, *columns)
    return rows.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A comma-separated table with a header in every part."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def merge_shards(spark: SparkSession, pattern: str, columns: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all shard tables, and a row with how many repeat a key of an earlier one."""
    rows = read_columns(spark, pattern, columns)
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows, counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def wide_counts(rows: DataFrame, branches: list[str]) -> DataFrame:
    """Bins x branches as a table with a column for each of ``branches``, in their order."""
    wide = rows.groupBy("bin_start").pivot("branch", branches).agg(F.sum("n"))
    return wide.na.fill(0).orderBy("bin_start")


def write_wide(rows: DataFrame, branches: list[str], path: str, overwrite: bool = False) -> None:
    """The wide table as one tab-separated file: it has a row for each bin."""
    wide_counts(rows, branches).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("header", True).csv(path)


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """Replace just the partitions of ``key`` that ``rows`` has: writing twice gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def manifest(spark: SparkSession, inputs: list[str], arguments: dict) -> dict:
    """Arguments, and size and hash of every input file; files are hashed where they are."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", F.sha2("content", 256).alias("sha256"))
    return {"arguments": plain(arguments), "inputs": [r.asDict() for r in files.orderBy("path").collect()]}


def plain(value: object) -> object:
    """A JSON value: numbers that aren't finite are null, paths are strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, Path) else value


def load_config(path: str, defaults: dict, overrides: dict | None = None) -> dict:
    """Defaults, then a JSON file, then overrides; unknown keys are an error."""
    own = json.loads(Path(path).read_text())
    if unknown := sorted(set(own) - set(defaults)):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    return defaults | own | {k: v for k, v in (overrides or {}).items() if v is not None}


def with_files(rows: DataFrame, listing: DataFrame, key: str, name: str = "file_exists") -> DataFrame:
    """Whether a file is listed for each row: ``listing`` has ``key``."""
    return rows.join(listing.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))

"""Text files as rows with dense numbers, read by many tasks whatever the size of a file.

A task numbers the rows of its split; the counts of the splits before are added. The counts, a row for
each split, are written to the shared folder first, so the text itself is neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import folder

_FILE = ["file", "block"]


def numbered(spark: SparkSession, path: str | list[str], separator: str | None = None, skip_first: Column | None = None, glob: str | None = None) -> DataFrame:
    """``value``, ``file``, ``line`` (0 up in its file), ``number`` (0 up over all files by path), ``first`` and ``last`` in its file.

    ``separator`` parts the rows instead of line ends. Where ``skip_first`` holds for a file's first row,
    that row has no numbers (null) and the next one is 0.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("lineSep", separator) if separator else reader
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    skipped = F.coalesce(skip_first, F.lit(False)) if skip_first is not None else F.lit(False)
    counts = rows.groupBy(*_FILE).agg(F.count("*").alias("n"), F.min("at").alias("start"), F.min_by(skipped, "at").alias("head"))
    where = folder(spark, "splits")
    counts.write.parquet(where)
    counts = spark.read.schema(counts.schema).parquet(where)
    # the first row of a file begins where the file begins
    head = (F.col("head") & (F.col("block") == 0)).cast("long")
    earlier = lambda w: F.coalesce(F.sum(F.col("n") - head).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("file").orderBy("block")
    counts = counts.select(
        *_FILE, "start", head.alias("head"), earlier(own).alias("in_file"), earlier(Window.orderBy(*_FILE)).alias("in_all"),
        (F.sum(F.col("n") - head).over(Window.partitionBy("file")) - 1).alias("final"),
    )
    both = rows.join(counts, _FILE)
    place = F.col("at") - F.col("start") - F.col("head")
    line = F.when(place >= 0, F.col("in_file") + place)
    first = (F.col("block") == 0) & (F.col("at") == F.col("start"))
    return both.select("value", "file", line.alias("line"), F.when(place >= 0, F.col("in_all") + place).alias("number"), first.alias("first"), F.coalesce(line == F.col("final"), F.lit(False)).alias("last"))


def cells(line: Column) -> Column:
    """Cells of a tab-separated line; quoted ones lose their quotes."""
    quoted = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit('\t("(?:[^"]|"")*"|[^\t]*)'), 1)
    bare = F.transform(quoted, lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, "\t"))

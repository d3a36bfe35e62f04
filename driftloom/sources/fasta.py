"""Sequence files: reading with one row per record, and writing, whole or in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import hash_owner, upper
from ..operators.joins import held
from .lines import numbered

# The fields of an isolate's header.
ISOLATE_FIELDS = (
    "virus_name", "isolate_id", "type", "passage_details", "lineage", "clade", "collection_date", "submitter", "sample_id_provider",
    "sample_id_submitting_lab", "last_modified", "originating_lab", "submitting_lab", "gene_name", "protein_accession_no",
)


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text from one header to the next; what stands before the first header of a file has no number."""
    return numbered(spark, path, "\n>", skip_first=~F.col("value").rlike("^\ufeff?\\s*>"))


def read_fasta(spark: SparkSession, path: str | list[str], on_orphan: str = "error", on_empty: str = "keep", id_only: bool = False) -> DataFrame:
    """``record_index``, ``header`` and ``sequence`` of the records of one or more files.

    Files are split at line starts with ``>``, so a record is one row however it is wrapped, and large
    files are read by many tasks. Blank lines and white space inside sequences go, letters are made
    upper case, a byte-order mark is ignored. Sequence lines before the first header are an error or
    dropped; records without sequence are kept, dropped or an error. ``record_index`` is 0 to the number
    of records less one, by path and place, at any split size; a dropped empty record keeps its number.
    With ``id_only`` the header ends at its first blank.
    """
    if on_orphan not in ("error", "drop") or on_empty not in ("error", "keep", "drop"):
        raise ValueError("on_orphan is error or drop, on_empty is error, keep or drop")
    rows = _records(spark, path)
    if on_orphan == "error":
        rows = held(rows, F.col("number").isNotNull() | F.col("value").rlike("^\ufeff?\\s*$"), "a sequence line stands before the first header")
    text = F.regexp_replace(F.col("value"), "\r", "")
    record = F.when(F.col("first"), F.regexp_replace(text, "^\ufeff?\\s*>", "")).otherwise(text)
    rows = rows.where("number is not null").select(F.col("number").alias("record_index"), record.alias("record"))
    header = F.trim(F.substring_index("record", "\n", 1))
    body = F.when(F.instr("record", "\n") > 0, F.substring(F.col("record"), F.instr("record", "\n") + 1, F.length("record"))).otherwise("")
    if id_only:
        header = F.coalesce(F.nullif(F.regexp_extract(header, r"^(\S+)", 1), F.lit("")), F.concat(F.lit("sequence_"), F.col("record_index").cast("string")))
    out = rows.select("record_index", header.alias("header"), upper(F.regexp_replace(body, r"\s+", "")).alias("sequence"))
    if on_empty == "drop":
        return out.where("sequence <> ''")
    return held(out, F.col("sequence") != "", "a record has no sequence") if on_empty == "error" else out


def isolate_headers(records: DataFrame) -> DataFrame:
    """Headers of exactly 15 pipe fields as columns, with the collection date as a date."""
    fields = F.split("header", r"\|")
    checked = F.when(F.size(fields) == len(ISOLATE_FIELDS), fields).otherwise(F.raise_error("a header has not 15 fields").cast("array<string>"))
    rows = records.select(checked.alias("f")).select(*[F.trim(F.col("f")[i]).alias(c) for i, c in enumerate(ISOLATE_FIELDS)])
    return rows.withColumn("collection_date", F.try_to_date("collection_date", "yyyy-MM-dd"))


def read_two_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record_index``, ``header`` and ``sequence`` of files that strictly have a header line and one sequence line by turns.

    Anything else is an error: a first line without ``>``, a second sequence line, a blank line, a header
    without a line after it. Lines may end with CR and LF; a sequence line may be empty.
    """
    rows = _records(spark, path)
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r$", "")
    text = F.when(F.col("first"), F.regexp_replace(text, "^>", "")).otherwise(text)
    # the last record has the line end that parts the others
    cut = F.split(F.when(F.col("last"), F.regexp_replace(text, "\n\\z", "")).otherwise(text), "\n")
    right = F.col("number").isNotNull() & (~F.col("first") | F.col("value").startswith(">"))
    rows = held(rows.select("number", cut.alias("cut"), right.alias("right")), F.col("right") & (F.size("cut") == 2), "a record has not one header and one sequence line")
    return rows.select(F.col("number").alias("record_index"), F.col("cut")[0].alias("header"), F.col("cut")[1].alias("sequence"))


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose sequence is in ``wanted`` (column ``sequence``), each sequence once, by its first record."""
    first = F.min_by(F.struct("record_index", "header"), "record_index").alias("first")
    found = records.join(wanted.select("sequence").distinct(), "sequence", "left_semi").groupBy("sequence").agg(first)
    return found.select("first.*", "sequence")


def _lines(records: DataFrame) -> DataFrame:
    return records.select(F.concat(F.lit(">"), F.translate("header", " ", "_"), F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """One line for each header, blanks as ``_``, and one for each sequence."""
    _lines(records).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_shards(records: DataFrame, path: str, shards: int, overwrite: bool = False) -> None:
    """Records in ``shards`` folders by the 256-bit hash of their header."""
    if shards < 1:
        raise ValueError("shards must be positive")
    own = hash_owner(F.col("header"), shards)
    rows = records.select(own.alias("shard"), F.concat(F.lit(">"), F.translate("header", " ", "_"), F.lit("\n"), F.col("sequence")).alias("value"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("shard").text(path)


def merge_fasta(spark: SparkSession, paths: list[str], out: str, overwrite: bool = False) -> None:
    """Several files as one table of lines, line ends at every file's end."""
    spark.read.text(paths).where("trim(value) <> ''").write.mode("overwrite" if overwrite else "errorifexists").text(out)

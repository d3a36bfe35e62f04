"""Sequence tables: de-duplication, duplicate audits, consensus and position diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import upper
from .strains import position_counts


def keep_first(records: DataFrame) -> DataFrame:
    """The first record of each non-empty sequence, by record_index."""
    filled = records.where("sequence <> ''").withColumn("sha", F.sha2(F.col("sequence").cast("binary"), 256))
    first = F.min_by(F.struct("record_index", "header", "sequence"), "record_index").alias("first")
    return filled.groupBy("sha").agg(first).select("first.*", "sha")


def prepare(records: DataFrame, tag: str = "|HA|", least: int = 560, tag_first: bool = False) -> DataFrame:
    """First copies with a header tag and a least length; by default copies go before the tag is looked at."""
    tagged = F.col("header").contains(tag)
    rows = keep_first(records.where(tagged)) if tag_first else keep_first(records).where(tagged)
    return rows.where(F.length("sequence") >= least)


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Groups of equal values and records beyond the first, for headers, sequences and gap-free sequences."""
    kinds = {"header": F.col("header"), "aligned": F.col("sequence"), "ungapped": F.regexp_replace("sequence", "-", "")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.sha2(c.cast("binary"), 256).alias("key")) for k, c in kinds.items()]))
    counts = records.select(pairs.alias("p")).groupBy("p.kind", "p.key").agg(F.count("*").alias("c"))
    return counts.groupBy("kind").agg(F.count_if(F.col("c") > 1).alias("groups"), F.sum(F.col("c") - 1).alias("extra_records"))


def consensus(sequences: DataFrame, group: str, gap: str = "-") -> DataFrame:
    """The most frequent letter of every position of each group, gaps left out, ties by letter."""
    counts = position_counts(sequences, [group], "sequence").where(F.col("letter") != gap)
    best = counts.groupBy(group, "pos").agg(F.min_by("letter", F.struct(-F.col("n"), F.col("letter"))).alias("letter"))
    return best.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"))


def diversity(sequences: DataFrame) -> DataFrame:
    """Different letters at every position, and whether it never changes."""
    counts = position_counts(sequences, [], "sequence")
    return counts.groupBy("pos").agg(F.count("*").alias("letters"), F.sum("n").alias("n")).withColumn("unchanged", F.col("letters") == 1)


def nucleotide_like(records: DataFrame, first: int = 100, share: float = 0.97) -> DataFrame:
    """Whether the first records are nearly all made of nucleotide letters: one row."""
    some = records.where(F.col("record_index") < first)
    letters = F.sum(F.length(F.regexp_replace(upper(F.col("sequence")), "[^ACGTUN]", "")))
    return some.agg(letters.alias("nucleotide_letters"), F.sum(F.length("sequence")).alias("letters")).withColumn(
        "is_nucleotide", F.coalesce(F.try_divide("nucleotide_letters", "letters") >= share, F.lit(False))
    )

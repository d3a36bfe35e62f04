"""From raw documents to packed sequences: language, toxicity, near duplicates, repeated bytes, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
whole rows with the columns of ``documents``. Stages are written as Parquet in the shared folder and
read again, so a lost executor costs one stage's tasks at most. Rows with a null doc_id pass the
filters by their text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import langid, minhash, packing, suffix, toxicity
from driftloom.llm.queries import VOCABULARY, fold
from driftloom.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from those with a language, a fifth held out.

    Null and empty texts, and texts without a letter, have no language and go. Very long texts are read as a whole.
    """
    return langid.accepted(spark, docs, langid.fit(docs.where(fold(5) != 0)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold; learned from labels, a quarter held out.

    Null and empty texts have the score of no words. Very long texts are read as a whole.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2)
    return toxicity.accepted(spark, docs, toxicity.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id.

    Null and empty texts are near nothing and stay, as do rows with a null doc_id. Rows with one doc_id
    are one document; of those that also share their text one stays. Very long texts count as a whole.
    """
    found = minhash.groups(spark, docs)
    ids = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    kept = Scratch(spark, "distinct").keep(ids, "kept")
    doc_id = F.col("doc_id").cast("long")
    name = "kept_id"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    own = docs.join(kept.select(F.col("doc_id").alias(name)).hint("merge"), doc_id == F.col(name), "left_semi").unionByName(docs.where(doc_id.isNull()))
    if kept.where("n_rows > 1").isEmpty():
        return own
    return own.where(doc_id.isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(own.where(doc_id.isNull()))


#: Bytes of a string whose later copies go: about 40 words of usual length, fewer than 50 short ones have; and of its anchor.
PASSAGE = 200
ANCHOR = 64


def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of byte strings of PASSAGE bytes or more.

    A null text stays null, an empty one empty; very long texts are cut as others are.
    """
    return suffix.trimmed(spark, docs, window=PASSAGE, gram=ANCHOR)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. Null and empty texts are one piece, their end token; very long ones are cut."""
    return packing.pack(spark, docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("toxicity", clean), ("minhash", distinct), ("suffix", trimmed), ("packing", packed)]
#: The stages learn, group and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

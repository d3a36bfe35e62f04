"""Labels, bins, windows, sequences, sources, panels and streams on small tables."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions import labels, sequences
from driftloom.operators import audit, joins, panels, scores, sequence_tables
from driftloom.plans import windows
from driftloom.sources import fasta, tables
from driftloom.streaming import bins


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_first_date_and_labels(spark):
    header = F.lit("A/x/2019|EPI_ISL_7|a|b|c|d|e|2021-04-05|2022-01-01")
    assert one(spark, labels.first_date(header)) == date(2021, 4, 5)
    assert one(spark, labels.first_date(F.lit("12020-01-011|2020-13-40"))) is None
    assert one(spark, labels.accession(header)) == "EPI_ISL_7"
    # own label rows: both columns named, the first one blank, and only the old name usable
    rows = [("old one", "Q.7", "Q"), ("old two", " ", "R.3"), ("old three", "none", "Unassigned")]
    df = spark.createDataFrame(rows, "legacy string, subclade string, clade string")
    assert [r[0] for r in df.select(labels.branch_label("nextclade")).collect()] == ["Q.7", "R.3", "old three"]
    assert [r[0] for r in df.select(labels.branch_label("legacy")).collect()] == [r[0] for r in rows]
    with pytest.raises(ValueError):
        labels.branch_label("other")
    assert one(spark, labels.safe_number(F.lit(" 1.5 "))) == 1.5 and one(spark, labels.safe_number(F.lit("inf"))) is None


def test_bins_and_shares(spark):
    rows = [(date(2020, 1, 1), "A"), (date(2020, 1, 2), "A"), (date(2020, 1, 15), "A"), (date(2020, 1, 16), "Unassigned")]
    got = windows.binned(spark.createDataFrame(rows, "collection_date date, branch string"), date(2020, 1, 1), date(2020, 1, 28)).collect()
    cells = {(r["bin_start"], r["branch"]): r for r in got}
    assert cells[date(2020, 1, 1), "A"]["n"] == 2 and cells[date(2020, 1, 15), "Unassigned"]["share"] == 0.5
    assert {r["branch"]: r["branch_pos"] for r in got} == {"Unassigned": 1, "A": 2}
    with pytest.raises(ValueError):
        windows.binned(spark.createDataFrame(rows, "collection_date date, branch string"), date(2020, 1, 1), days=0)


def test_aligned_windows(spark):
    days = pd.date_range("2019-01-01", "2020-09-30")
    rows = spark.createDataFrame([(d.date(), "A" if d.day % 2 else "B") for d in days], "collection_date date, branch string")
    span = spark.createDataFrame([(0, date(2020, 4, 1), date(2020, 9, 30))], "window_id int, start date, end date")
    got = windows.aligned_counts(rows, span, date(2019, 1, 1)).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    sums = {r["bin"]: r["n"] for r in got}
    assert sums[0] == 14 and max(sums) == 12 and sum(n for b, n in sums.items() if b >= 0) == 182


def test_sequences(spark):
    assert one(spark, sequences.translate(F.lit("ATGGCCTAA"))) == "MA" and one(spark, sequences.translate(F.lit("ATNN"))) == "X"
    assert one(spark, sequences.translate(F.lit("TAATAA"), strip="all")) == "" and one(spark, sequences.translate(F.lit("A"))) == ""
    import hashlib

    assert one(spark, sequences.hash_owner(F.lit("key"), 13)) == int(hashlib.sha256(b"key").hexdigest(), 16) % 13
    assert one(spark, sequences.hamming(F.lit("ABC"), F.lit("ABD"))) == 1 and one(spark, sequences.hamming(F.lit("A"), F.lit("AB"))) is None
    df = spark.createDataFrame([(0, "h", "AC"), (1, "h", "AC"), (2, "k", "A-"), (3, "l", "")], "record_index long, header string, sequence string")
    assert [r["record_index"] for r in sequence_tables.keep_first(df).orderBy("record_index").collect()] == [0, 2]
    assert sequence_tables.consensus(df.where("sequence <> ''").withColumn("g", F.lit(1)), "g").first()["consensus"] == "AC"


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes("﻿>one x\r\nac\r\n\r\ngt\r\n>two\nAA AA\n>three\n".encode())
    got = {r["header"]: r["sequence"] for r in fasta.read_fasta(spark, f"file://{tmp_path}/a.fasta").collect()}
    assert got == {"one x": "ACGT", "two": "AAAA", "three": ""}
    assert {r["header"] for r in fasta.read_fasta(spark, f"file://{tmp_path}/a.fasta", on_empty="drop", id_only=True).collect()} == {"one", "two"}
    fasta.write_shards(fasta.read_fasta(spark, f"file://{tmp_path}/a.fasta"), f"file://{tmp_path}/out", 2)
    assert spark.read.text(f"file://{tmp_path}/out").where("value = '>one_x'").count() == 1
    (tmp_path / "b.fasta").write_text("ACG\n>x\nAA\n")
    assert fasta.read_fasta(spark, f"file://{tmp_path}/b.fasta", on_orphan="drop").count() == 1
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, f"file://{tmp_path}/b.fasta").collect()


def test_annotations_and_manifest(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("seqName\tsubclade\tclade\textra\nA|2020-01-02|x\tUnassigned\tC\t1\n")
    row = tables.read_annotations(spark, f"file://{tmp_path}/t.tsv").first()
    assert (row["branch"], row["collection_date"]) == ("C", date(2020, 1, 2))
    assert tables.manifest(spark, [f"file://{tmp_path}/t.tsv"], {"x": float("nan")})["arguments"] == {"x": None}
    lines = tables.read_lines(spark, f"file://{tmp_path}")
    assert audit.ragged_lines(lines).first()["ragged_rows"] == 0


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c"), (2, "d")], "k int, y string")
    assert joins.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(ValueError):
        joins.checked_join(left, right, ["k"], validate="one_to_one")


def test_scores_and_panels(spark):
    pairs = spark.createDataFrame([(1, 1, 0.1, 1.0), (1, 2, 0.2, 2.0), (1, 3, 0.9, 1.0)], "query_id int, reference_id int, distance double, weight double")
    r = scores.weighted_summary(pairs, ["query_id"]).first()
    assert (r["mean"], r["p50"], r["p10"], r["p90"]) == pytest.approx((0.35, 0.2, 0.1, 0.9))
    with pytest.raises(ValueError):
        scores.require_complete(spark.createDataFrame([("s", None)], "source string, score double"))
    assert panels.seats({0: 1, 1: 9, 2: 9}, 10, 3) == {0: 1, 1: 5, 2: 4}


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, date(2020, 1, 1 + i), "AB"[i % 2]) for i in range(28)], "id int, d date, b string")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    query = bins.stream_bins(stream, "d", "b", date(2020, 1, 1)).writeStream.format("memory").queryName("binned").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["bin_start"], r["branch"]): r["n"] for r in spark.table("binned").collect()}
    batch = windows.binned(rows.select(F.col("d").alias("collection_date"), F.col("b").alias("branch")), date(2020, 1, 1)).collect()
    assert got == {(r["bin_start"], r["branch"]): r["n"] for r in batch}

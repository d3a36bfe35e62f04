"""Dense numbers at any split size, and strict files of two lines a record."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import sequence_tables
from driftloom.sources import fasta, lines, tables


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", ["7", "100", "1000", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_numbered_without_gaps(spark, tmp_path, split, size, end):
    split(size)
    want = []
    for name, n, lead in (("a", 37, "﻿"), ("b", 1, "\n\n"), ("c", 25, "")):
        records = [(f"{name}{i} x", "ACGT" * (i % 9) + "N") for i in range(n)]
        want += records
        body = "".join(f">{h}{end}" + "".join(f"{s[k : k + 10].lower()}{end}" for k in range(0, len(s), 10)) for h, s in records)
        (tmp_path / f"{name}.fasta").write_bytes((lead + body).encode())
    got = fasta.read_fasta(spark, f"file://{tmp_path}").orderBy("record_index").collect()
    assert [tuple(r) for r in got] == [(i, h, s) for i, (h, s) in enumerate(want)]
    shards = fasta.read_fasta(spark, f"file://{tmp_path}").groupBy(F.pmod("record_index", F.lit(3)).alias("s")).count().collect()
    assert {r["s"]: r["count"] for r in shards} == {0: 21, 1: 21, 2: 21}


def test_the_first_hundred_records_tell_nucleotides(spark, tmp_path, split):
    split("500")
    (tmp_path / "a.fasta").write_text("".join(f">r{i}\n{'ACGT' if i < 100 else 'MKVLWWEE'}\n" for i in range(400)))
    found = sequence_tables.nucleotide_like(fasta.read_fasta(spark, f"file://{tmp_path}")).collect()
    assert len(found) == 1 and True in found[0].asDict().values()


BAD = ["ACGT\n>a\nAC\n", ">a\nAC\nGT\n>b\nAC\n", ">a\n\n>b\n", ">a\nAC\n\n>b\nAC\n", ">a\nAC\n\n", ">a\n>b\nAC\n", ">a\nAC\n>b\n", "\n>a\nAC\n", ">a\nAC\n>b", " >a\nAC\n"]


@pytest.mark.parametrize("text", BAD)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_line_out_of_turn_is_an_error(spark, tmp_path, text, end):
    (tmp_path / "x.fasta").write_bytes(text.replace("\n", end).encode())
    for act in (lambda d: d.count(), lambda d: d.select("header").collect()):
        with pytest.raises(Exception, match="one header and one sequence"):
            act(fasta.read_two_lines(spark, f"file://{tmp_path}/x.fasta"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("tail", [True, False])
def test_two_lines_a_record(spark, tmp_path, split, end, tail):
    split("9")
    text = end.join(f">h{i}{end}{'AC' * (i % 4)}" for i in range(30)) + (end if tail else "")
    (tmp_path / "x.fasta").write_bytes((text if tail else text + "A").encode())
    got = fasta.read_two_lines(spark, f"file://{tmp_path}/x.fasta").orderBy("record_index").collect()
    assert [tuple(r) for r in got] == [(i, f"h{i}", "AC" * (i % 4) + ("A" if i == 29 and not tail else "")) for i in range(30)]


def test_orphans_and_empty_records(spark, tmp_path):
    (tmp_path / "x.fasta").write_text("ACGT\n>a\nAC\n>b\n>c\nGT\n")
    path = f"file://{tmp_path}/x.fasta"
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, path).count()
    assert [tuple(r) for r in fasta.read_fasta(spark, path, on_orphan="drop", on_empty="drop").orderBy("record_index").collect()] == [(0, "a", "AC"), (2, "c", "GT")]
    with pytest.raises(Exception, match="no sequence"):
        fasta.read_fasta(spark, path, on_orphan="drop", on_empty="error").count()


def test_lines_of_tables_and_their_cells(spark, tmp_path, split):
    split("11")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tsv").write_bytes("﻿x\ty\r\n1\t2\r\n3\r\n".encode())
    (tmp_path / "sub" / "b.tsv").write_text('x\ty\n"a\t""b"""\tc\n')
    (tmp_path / "c.txt").write_text("no\n")
    got = tables.read_lines(spark, f"file://{tmp_path}").withColumn("c", lines.cells(F.col("value"))).orderBy("file", "line").collect()
    assert [(r["line"], r["c"]) for r in got] == [(0, ["x", "y"]), (1, ["1", "2"]), (2, ["3"]), (0, ["x", "y"]), (1, ['a\t"b"', "c"])]

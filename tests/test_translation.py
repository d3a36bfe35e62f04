"""Translation and pieces against definitions letter by letter, and the time of a long text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftloom.functions import sequences
from driftloom.plans import standins


def protein(text, frame, strip):
    clean = (text or "").translate(str.maketrans("acgtu", "ACGTU")).replace("U", "T")
    codons = [clean[i : i + 3] for i in range(frame, len(clean) - 2, 3)]
    acids = "".join(sequences.AMINO_ACIDS[sum(sequences.BASES.index(c) * 4 ** (2 - i) for i, c in enumerate(x))] if set(x) <= set(sequences.BASES) else "X" for x in codons)
    return {"one": acids[:-1] if acids.endswith("*") else acids, "all": acids.rstrip("*"), "none": acids}[strip]


def test_translation_equals_codons_one_by_one(spark):
    r = random.Random(5)
    texts = [None, "", "A", "TA", "TAA", "TAATAA", "UAAuag", "éATG", "AT\U0001f600TAATGA"] + ["".join(r.choice("ACGTUacgtuN") for _ in range(r.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(3)
    for strip in ("one", "all", "none"):
        got = df.select("i", *[sequences.translate(F.col("s"), f, strip).alias(f"f{f}") for f in range(3)]).collect()
        assert all(x[f"f{f}"] == protein(texts[x["i"]], f, strip) for x in got for f in range(3))
    best = df.select("i", sequences.frame_candidates(F.col("s"), 2).alias("c")).collect()
    for x in best:
        assert x["c"] == sorted({p for p in (protein(texts[x["i"]], f, "one") for f in range(3)) if len(p) >= 2 and "*" not in p})


def test_no_codon_is_looked_up_by_an_expression_of_its_own(spark):
    df = spark.range(10).select(F.repeat(F.lit("ACGTTGCANNACGGTA"), 4).alias("s"))
    found = df.select(*[sequences.translate(F.col("s"), f).alias(f"f{f}") for f in range(3)])
    assert "lambdafunction" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("length", [64, 5])
def test_pieces_of_texts(spark, tmp_path, length):
    r = random.Random(6)
    texts = ["", None, "ab1", "x" * 64, "x" * 63, "A-b c\n" * 100, "é" * 70 + "q" * 130] + ["".join(r.choice("abcXYZ 1é\n") for _ in range(r.randrange(400))) for _ in range(50)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = standins.fixed_sequences(spark, str(tmp_path), length)
    assert rows.columns == ["record_index", "piece", "lang", "sequence"]
    want = {}
    for i, t in enumerate(texts):
        letters = "".join(c for c in (t or "").translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if "A" <= c <= "Z")
        want |= {(i, k): letters[k * length : (k + 1) * length] for k in range(len(letters) // length)}
    assert {(x["record_index"], x["piece"]): x["sequence"] for x in rows.collect()} == want


def test_one_long_text_takes_time_in_proportion(spark, tmp_path):
    # 60,000 pieces: 60,000 copies of the text, or substrings from its first letter, are 100 GB of letters
    spark.createDataFrame([(0, "abcdefgh" * 480_000, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    assert standins.fixed_sequences(spark, str(tmp_path)).agg(F.count("*"), F.min("sequence")).first()[0] == 60_000
    assert time.time() - began < 30

"""What SQL does not hold: fits, alignments, checks that fail, and labels by hand-written values."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.functions import alignment, labels
from driftloom.functions.simplex import log_factorial
from driftloom.operators import audit, fits, joins, panels, scores
from driftloom.plans import evaluate, forecast
from driftloom.sources import fasta, tables


def test_statuses_and_error_classes(spark):
    df = spark.createDataFrame([(x,) for x in ("unknown", "Unassigned ", " ", None, "C.1")], "x string")
    assert [r[0] for r in df.select(labels.label_status(F.col("x"))).collect()] == ["assigned", "unassigned", "blank", "blank", "assigned"]
    messages = {
        "Unknown nucleotide 'J'": "unknown_nucleotide", "Extracted gene sequence is empty": "gene_not_found_or_empty", "unable to find start of gene": "gene_not_found_or_empty",
        "Sequence is too short for translation": "sequence_or_gene_too_short", "Translation failed in alignment": "translation_error", "seed alignment failed": "alignment_error",
        "frame shift": "other", "Unable to align": "other",
    }
    rows = spark.createDataFrame([(m,) for m in messages], "m string")
    assert {r[0]: r[1] for r in rows.select("m", labels.error_class(F.col("m"))).collect()} == messages
    both = rows.union(spark.createDataFrame([("",), (None,), ("  ",)], "m string"))
    assert {r["category"]: r["n"] for r in audit.error_counts(both, "m").collect()}["other"] == 2
    f = spark.range(1).select(labels.audit_fields(F.lit("A|x| H1N1 |d|e||2020-01-02|2021-01-01"))).first()[0]
    assert tuple(f) == ("H1N1", "unknown", "2020")


def test_log_factorial(spark):
    rows = spark.createDataFrame([(float(n),) for n in (0, 1, 2, 5, 20, 1000, 10**7)], "y double")
    for r in rows.select("y", log_factorial(F.col("y")).alias("f")).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["y"] + 1), rel=1e-11, abs=1e-9)


def dense(spark):
    """The golden history as dense bins, with an empty one in the middle of the holdout."""
    shares, totals = [0.80, 0.75, 0.70, 0.64, 0.58, 0.52, 0.46, 0.40], [20, 40, 30, 80, 50, 100, 120, 90]
    rows, day = [], date(2023, 1, 1)
    for i, (a, n) in enumerate(zip(shares, totals)):
        if i == 7:
            rows += [(day, "A", 0.0), (day, "B", 0.0)]
            day += timedelta(days=14)
        rows += [(day, "A", a * n), (day, "B", (1 - a) * n)]
        day += timedelta(days=14)
    return spark.createDataFrame(rows, "bin_start date, branch string, n double")


def test_single_cutoff(spark):
    counts = evaluate.single_cutoff(dense(spark), date(2023, 3, 12), 3)
    assert counts.where("bin >= 0").select("bin").distinct().count() == 2  # the empty bin is no holdout
    found = forecast.share_persistence(counts).unionByName(forecast.share_trend(counts, 4)).unionByName(forecast.share_selection(counts, 4))
    got = {r["model"]: r for r in evaluate.metrics(evaluate.compared(counts, found)).collect()}
    assert (got["F-B0"]["mae"], got["F-B0"]["mean_jsd"]) == pytest.approx((0.09, 0.004533), abs=1e-6)
    assert got["F-B1"]["mae"] == pytest.approx(0, abs=1e-6) and got["F-B2"]["mae"] == pytest.approx(0.003871, abs=1e-6)
    with pytest.raises(ValueError):
        evaluate.single_cutoff(dense(spark), date(2022, 3, 12), 3)
    steps = {r["step"] for r in evaluate.history_slice(dense(spark), date(2023, 3, 12), 3, 4).collect()}
    assert steps == set(range(-3, 4))
    with pytest.raises(ValueError):
        evaluate.history_slice(dense(spark), date(2023, 3, 12), 4, 4)


def test_alignment():
    assert alignment.aligned("ACDEF", "ACDEF") == "ACDEF"
    assert alignment.aligned("ACDF", "ACDEF") in ("ACD-F",)
    assert alignment.aligned("ACDWWEF", "ACDEF") == "ACDEF"
    assert alignment.aligned("", "ACD") == "---" and alignment.aligned("ACD", "") == ""

    def score(a, b):
        # every way of two short strings
        best = {}

        def go(i, j, state):
            if (i, j, state) in best:
                return best[i, j, state]
            if i == len(a) and j == len(b):
                return 0
            found = []
            if i < len(a) and j < len(b):
                found.append((2 if a[i] == b[j] else -1) + go(i + 1, j + 1, 0))
            if i < len(a):
                found.append((-1 if state == 1 else -5) + go(i + 1, j, 1))
            if j < len(b):
                found.append((-1 if state == 2 else -5) + go(i, j + 1, 2))
            best[i, j, state] = max(found)
            return best[i, j, state]

        return go(0, 0, 0)

    r = np.random.default_rng(4)
    for _ in range(60):
        reference, other = ("".join(r.choice(list("AC"), r.integers(1, 7))) for _ in range(2))
        out = alignment.aligned(other, reference)
        assert len(out) == len(reference) and out.replace("-", "") == "".join(x for x in out if x != "-")
        if len(reference) == len(other) and out == other:
            assert score(reference, other) == sum(2 if x == y else -1 for x, y in zip(reference, other))


def test_sets_of_features(spark):
    r = np.random.default_rng(2)
    rows = []
    for w in range(7):
        x, offset = r.normal(size=3), np.log(r.dirichlet(np.ones(3)))
        e = np.exp(offset + 0.8 * x)
        rows += [(w, "abc"[i], float(offset[i]), float((e / e.sum())[i]), float(x[i])) for i in range(3)]
    df = spark.createDataFrame(rows, "window_id int, branch string, offset double, observed double, x double")
    found = fits.rolling_sets(df, {"plain": (), "x": ("x",)}, l2=1e-6).toPandas()
    error = (found["value"] - found["observed"]).abs().groupby(found["model"]).max()
    assert error["x"] < 1e-3 < error["plain"] and found["window_id"].min() == 3
    held = fits.rolling_sets(df, {"x": ("x",)}, l2=1e-6, floors={"x": 5.0}).toPandas()
    assert (held["value"] - held["observed"]).abs().max() > 0.05


def test_rank_correlation_and_hits(spark):
    rows = [(w, "ab"[i], 0.5, 0.5 + d, d, p) for w, (d0, p) in enumerate([(0.2, 0.1), (-0.1, 0.3), (0.3, 0.2)]) for i, d in ((0, d0), (1, -d0))]
    rows = [(w, b, c, n, s, p if b == "a" else -p) for w, b, c, n, s, p in rows]
    df = spark.createDataFrame(rows, "window_id int, branch string, current_share double, next_share double, share_change double, predicted double")
    frame = pd.DataFrame(rows, columns=df.columns)
    got = fits.change_metrics(df).first()
    assert got["n_rows"] == 6 and got["cutoffs"] == 3 and got["top1_hits"] == 2
    assert got["spearman"] == pytest.approx(frame["predicted"].rank().corr(frame["share_change"].rank()))
    assert got["share_change_mae"] == pytest.approx((frame["predicted"] - frame["share_change"]).abs().mean())


def test_checks_that_fail(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "a", 3)], "k int, x string, y int")
    with pytest.raises(Exception, match="no partner"):
        joins.complete_join(left, right.drop("x"), ["k"], "y").collect()
    assert joins.agreeing_join(left.where("k = 1"), right, ["k"], ["x"]).first()["y"] == 3
    with pytest.raises(Exception, match="disagree"):
        joins.agreeing_join(left.withColumn("x", F.lit("z")).where("k = 1"), right, ["k"], ["x"]).collect()
    scores.require_same_parameters({"a": 1}, {"a": 1})
    with pytest.raises(ValueError, match="a, b"):
        scores.require_same_parameters({"a": 1}, {"a": 2, "b": 1})
    (tmp_path / "x.fasta").write_text(">a\nAC\n>b\nAC\nGT\n")
    with pytest.raises(Exception, match="one header and one sequence"):
        fasta.read_two_lines(spark, f"file://{tmp_path}/x.fasta").collect()
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,2\nq,\"y,z\",3\n")
    assert [tuple(r) for r in tables.read_columns(spark, f"file://{tmp_path}/t.csv", {"a": "int", "b": "string"}).collect()] == [(1, "x"), (None, "y,z")]


def test_past_panel_leaves_out_what_is_seen_now(spark):
    rows = [(1, "AAAA", date(2019, 3, 1))] * 3 + [(1, "AAAA", date(2019, 9, 1))] + [(2, "CCCC", date(2018, 3, 1)), (3, "GGGG", date(2019, 3, 1)), (3, "GGGG", date(2020, 2, 1)), (4, "TTTT", date(2010, 1, 1))]
    df = spark.createDataFrame(rows, "query_id long, sequence string, date date")
    cut = spark.createDataFrame([(0, date(2020, 1, 1), date(2020, 6, 30))], "window_id int, recent_start date, recent_end date")
    got = {r["query_id"]: r for r in panels.past_panel(df, cut, 8).collect()}
    assert set(got) == {1, 2} and got[1]["weight"] == 4 and got[1]["date"] == date(2019, 9, 1)
    assert got[1]["reference_weight"] + got[2]["reference_weight"] == pytest.approx(1)

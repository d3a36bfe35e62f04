"""The nested audit report against a plain count over rows."""

import collections
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from driftloom.functions import labels
from driftloom.operators import table_audit

NAMES = ["seqName", "clade", "subclade", "qc.overallStatus", "qc.overallScore", "coverage", "errors", "warnings", "other"]
SUMS = ("assigned", "unassigned", "blank")


def status(v):
    v = (v or "").strip()
    return "blank" if not v else "unassigned" if v.lower() == "unassigned" else "assigned"


def some_rows(seed, n):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    rows = []
    for _ in range(n):
        name = f"n{r.randrange(n)}|x|{pick('H1', '', ' H3 ')}|y|z|{pick('L1', 'L2', '', 'L3')}|{pick('2020-01-02', '1999-12-31', 'no')}"
        row = [pick(name, name, ""), pick("A", "B ", "", "unassigned", "\xa0Unassigned"), pick("c", "", "d"), pick("good", "bad", "", " "), pick("1.5", "7", "", "x", "nan", "-2"), pick("0.5", "0.25"), pick("", "", "Translation failed", "alignment: bad"), pick("", "w"), "z"]
        rows.append((row + ["more"])[: pick(9, 9, 9, 9, 10, 7)])
    return rows


def want(rows):
    rows = [r for r in rows if r != [""]]
    cell = lambda r, c: r[NAMES.index(c)] if NAMES.index(c) < len(r) else None
    text = lambda r, c: (cell(r, c) or "").strip()
    n = len(rows)
    rate = lambda a, b=n: round(a / b, 6) if b else 0.0
    primary = [status(cell(r, "clade")) for r in rows]
    part = lambda i: [((text(r, "seqName").split("|") + [""] * 9)[i].strip() or "unknown") for r in rows]
    year = [next((p[:4] for p in text(r, "seqName").split("|") if p[:2] in ("19", "20") and p[4:5] == "-" and len(p) == 10), "unknown") for r in rows]

    def nested(keys):
        out = {}
        for k, p in zip(keys, primary):
            out.setdefault(k, collections.Counter())[p] += 1
        return {k: dict(v) for k, v in out.items()}

    either = [bool(text(r, "errors") or text(r, "warnings")) for r in rows]
    counted = lambda flags: {"n": sum(flags), "rate": rate(sum(flags))}
    top, metrics = {}, {}
    for c in ("clade", "subclade"):
        for s in set(primary):
            values = collections.Counter(text(r, c) or "<blank>" for r, p in zip(rows, primary) if p == s)
            top.setdefault(c, {})[s] = [{"value": v, "n": k} for v, k in sorted(values.items(), key=lambda x: (-x[1], x[0]))[:20]]
    for c in ("qc.overallScore", "coverage"):
        for s in set(primary):
            x = [float(text(r, c)) for r, p in zip(rows, primary) if p == s and text(r, c) not in ("", "x", "nan")]
            if x:
                metrics.setdefault(s, {})[c] = {"n": len(x), "median": round(statistics.median(x), 6), "mean": round(statistics.fmean(x), 6)}
    lineage = [{"value": k, "n": sum(v.values()), **{s: v.get(s, 0) for s in SUMS}, "not_assigned_rate": rate(v.get("unassigned", 0) + v.get("blank", 0), sum(v.values()))} for k, v in nested(part(5)).items()]
    errors = collections.Counter("translation_error" if "ransl" in text(r, "errors") else "alignment_error" for r in rows if text(r, "errors"))
    return {
        "rows": n, "unique_seqName": len({text(r, "seqName") for r in rows}), "duplicate_seqName_rows": n - len({text(r, "seqName") for r in rows}),
        "tsv_structure": {"rows_with_extra_columns": sum(len(r) > 9 for r in rows), "rows_with_missing_columns": sum(len(r) < 9 for r in rows)},
        "primary_clade": {s: counted([p == s for p in primary]) for s in SUMS},
        "rows_with_error_or_warning": {**counted(either), "by_primary_status": {s: sum(e and p == s for e, p in zip(either, primary)) for s in SUMS}},
        "rows_with_errors": counted([bool(text(r, "errors")) for r in rows]), "rows_with_warnings": counted([bool(text(r, "warnings")) for r in rows]),
        "error_categories": dict(errors), "assignment_fields": {c: dict(collections.Counter(status(cell(r, c)) for r in rows)) for c in ("clade", "subclade")},
        "assignment_value_top": top, "qc_by_primary_status": nested([text(r, "qc.overallStatus") or "blank" for r in rows]), "metrics_by_primary_status": metrics,
        "year_by_primary_status": nested(year), "metadata_lineage_top": sorted(lineage, key=lambda x: (-x["n"], x["value"])), "metadata_subtype": nested(part(2)),
    }


@pytest.mark.parametrize("size", ["300", "128m"])
def test_report_of_each_file(spark, tmp_path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        files = {f"{k}.tsv": some_rows(k, n) for k, n in ((1, 200), (2, 40))}
        for name, rows in files.items():
            body = "\r\n".join(["\t".join(NAMES), *("\t".join(r) for r in rows[:20]), "", *("\t".join(r) for r in rows[20:])])
            (tmp_path / name).write_bytes(("﻿" + body + "\r\n").encode())
        got = {r["file"].rsplit("/")[-1]: json.loads(r["report"]) for r in table_audit.report(table_audit.counters(spark, f"file://{tmp_path}")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: want(v) for k, v in files.items()}


def test_white_space_of_any_kind_is_stripped(spark):
    values = [f"{a}Unassigned{b}" for a in ("\t", " ", "\xa0", " ") for b in ("\r", "\n", "", "\x1f")]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0] for r in df.select(labels.label_status(F.col("v"))).collect()} == {"unassigned"}
    assert {r[0] for r in df.select(labels.clean_label(F.col("v"))).collect()} == {None}
    assert df.select(labels.clean_label(F.lit("\tC.1\r"))).first()[0] == "C.1"
    assert df.select(labels.safe_number(F.lit("\t1.5\r"))).first()[0] == 1.5

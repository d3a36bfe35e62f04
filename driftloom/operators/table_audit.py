"""Audit of annotation tables: all counters from one pass over the lines, and the nested report of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import audit_fields, error_class, label_status, safe_number, stripped
from ..sources.lines import cells
from ..sources.tables import read_lines

# Columns that assign a record, metrics, the columns of names and messages, and the statuses.
ASSIGNMENTS = ("clade", "proposedSubclade", "subclade", "short-clade", "legacy-clade", "legacy-clade-vic", "legacy-clade-yam", "lineage")
METRICS = ("qc.overallScore", "coverage", "totalMissing", "totalNonACGTNs", "totalFrameShifts", "totalUnknownAa", "alignmentStart", "alignmentEnd")
NAME, PRIMARY, QUALITY, ERRORS, WARNINGS = "seqName", "clade", "qc.overallStatus", "errors", "warnings"
STATUSES = ("assigned", "unassigned", "blank")
BLANK = "<blank>"
TOP = 20


def counters(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """``file``, ``section``, ``field``, ``value``, ``status`` and ``n``, from one aggregate over the lines of all tables under ``path``.

    Every line gives an entry for each section that it counts in; a name is an entry too, so repeated
    names come out of the same aggregate. Empty lines don't count; quoted cells may hold tabs, not line ends.
    """
    lines = read_lines(spark, path, glob).where("value <> ''").select("file", "line", cells(F.col("value")).alias("cells"))
    # a row for each file
    names = lines.where("line = 0").select("file", F.col("cells").alias("names"))
    rows = lines.where("line > 0").join(names, "file")
    cell = lambda c: F.get("cells", (F.array_position("names", F.lit(c)) - 1).cast("int"))
    there = lambda c: F.array_contains("names", F.lit(c))
    name = F.coalesce(stripped(cell(NAME)), F.lit(""))
    rows = rows.select("file", "names", "cells", name.alias("name"), label_status(cell(PRIMARY)).alias("primary"), audit_fields(name).alias("m"), F.coalesce(stripped(cell(ERRORS)), F.lit("")).alias("errors"), F.coalesce(stripped(cell(WARNINGS)), F.lit("")).alias("warnings"))
    none = F.lit("")

    def entry(section: str, field: Column | str, value: Column, status: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(section).alias("section"), (F.lit(field) if isinstance(field, str) else field).alias("field"), value.alias("value"), status.alias("status"))
        return made if when is None else F.when(when, made)

    primary, quality = F.col("primary"), F.coalesce(F.nullif(stripped(cell(QUALITY)), none), F.lit("blank"))
    both = (F.col("errors") != "") | (F.col("warnings") != "")
    entries = [
        entry("rows", "", none, primary),
        entry("structure", "extra", none, none, F.size("cells") > F.size("names")),
        entry("structure", "missing", none, none, F.size("cells") < F.size("names")),
        entry("name", "", F.col("name"), none),
        entry("messages", "errors", none, none, F.col("errors") != ""),
        entry("messages", "warnings", none, none, F.col("warnings") != ""),
        entry("messages", "either", none, primary, both),
        entry("error", "", error_class(F.col("errors")), none, F.col("errors") != ""),
        entry("quality", "", quality, primary),
        *[entry(k, "", F.col(f"m.{k}"), primary) for k in ("year", "lineage", "subtype")],
    ]
    for c in ASSIGNMENTS:
        entries.append(entry("assignment", c, none, label_status(cell(c)), there(c)))
        entries.append(entry("value", c, F.coalesce(F.nullif(stripped(cell(c)), none), F.lit(BLANK)), primary, there(c)))
    for c in METRICS:
        number = safe_number(cell(c))
        entries.append(entry("metric", c, number.cast("string"), primary, number.isNotNull()))
    exploded = rows.select("file", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return exploded.groupBy("file", "e.section", "e.field", "e.value", "e.status").agg(F.count("*").alias("n"))


def _map(rows: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """A map column from ``name`` to ``value`` of the rows of each of ``keys``, in the order of the names."""
    by_name = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), value.alias("value"))), by_name)
    return rows.groupBy(*keys).agg(F.map_from_entries(pairs).alias("found"))


def _rate(n: Column, d: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(n, d), 6), F.lit(0.0))


def report(counted: DataFrame) -> DataFrame:
    """``file`` and ``report``, its nested JSON: every map is by name, every list by falling count, then name."""
    section = lambda s: counted.where(F.col("section") == s)
    n_of = lambda s, f, st: F.coalesce(F.sum(F.when((F.col("section") == s) & (F.col("field") == f) & (F.col("status") == st if st is not None else F.lit(True)), F.col("n"))), F.lit(0))
    sums = counted.groupBy("file").agg(
        n_of("rows", "", None).alias("rows"), *[n_of("rows", "", s).alias(f"p_{s}") for s in STATUSES], *[n_of("messages", "either", s).alias(f"e_{s}") for s in STATUSES],
        n_of("messages", "either", None).alias("either"), n_of("messages", "errors", None).alias("errors"), n_of("messages", "warnings", None).alias("warnings"),
        n_of("structure", "extra", None).alias("extra"), n_of("structure", "missing", None).alias("missing"), F.count_if(F.col("section") == "name").alias("names"),
    )
    n, total = F.col("n"), F.col("rows")
    by_status = lambda s: _map(_map(section(s), ["file", "value"], "status", n), ["file"], "value", F.col("found"))
    fields = _map(_map(section("assignment"), ["file", "field"], "status", n), ["file"], "field", F.col("found"))
    rank = F.row_number().over(Window.partitionBy("file", "field", "status").orderBy(F.desc("n"), "value"))
    leading = section("value").withColumn("rank", rank).where(F.col("rank") <= TOP)
    leading = leading.groupBy("file", "field", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))
    leading = _map(_map(leading, ["file", "field"], "status", F.col("top")), ["file"], "field", F.col("found"))
    # medians from the counts of different values, which a window adds up in order
    own = Window.partitionBy("file", "field", "status")
    numbers = section("metric").withColumn("x", F.col("value").cast("double"))
    numbers = numbers.withColumns({"upto": F.sum("n").over(own.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(own)})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("x")))
    half = lambda add: F.floor((F.col("all") + add) / 2)
    metrics = numbers.groupBy("file", "field", "status").agg(F.max("all").alias("n"), ((at(half(-1)) + at(half(0))) / 2).alias("median"), (F.sum(F.col("x") * n) / F.sum("n")).alias("mean"))
    summary = F.struct("n", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))
    metrics = _map(_map(metrics.withColumn("summary", summary), ["file", "status"], "field", F.col("summary")), ["file"], "status", F.col("found"))
    lineages = section("lineage").groupBy("file", "value").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("status") == s, n)), F.lit(0)).alias(s) for s in STATUSES])
    lineages = lineages.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= TOP)
    rated = F.struct("rank", "value", "n", *STATUSES, _rate(F.col("unassigned") + F.col("blank"), n).alias("not_assigned_rate"))
    lineages = lineages.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(rated)), lambda x: x.dropFields("rank")).alias("found"))
    errors = section("error").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "value")))
    errors = errors.groupBy("file").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"], x["n"]))).alias("found"))
    parts = {
        "error_categories": errors, "assignment_fields": fields, "assignment_value_top": leading, "qc_by_primary_status": by_status("quality"), "metrics_by_primary_status": metrics,
        "year_by_primary_status": by_status("year"), "metadata_lineage_top": lineages, "metadata_subtype": by_status("subtype"),
    }
    out = sums
    for name, part in parts.items():
        out = out.join(part.select("file", F.col("found").alias(name)), "file", "left")
    counted_of = lambda c: F.struct(F.col(c).alias("n"), _rate(F.col(c), total).alias("rate"))
    whole = F.struct(
        "rows", F.col("names").alias("unique_seqName"), (total - F.col("names")).alias("duplicate_seqName_rows"),
        F.struct(F.col("extra").alias("rows_with_extra_columns"), F.col("missing").alias("rows_with_missing_columns")).alias("tsv_structure"),
        F.struct(*[counted_of(f"p_{s}").alias(s) for s in STATUSES]).alias("primary_clade"),
        F.struct(F.col("either").alias("n"), _rate(F.col("either"), total).alias("rate"), F.struct(*[F.col(f"e_{s}").alias(s) for s in STATUSES]).alias("by_primary_status")).alias("rows_with_error_or_warning"),
        counted_of("errors").alias("rows_with_errors"), counted_of("warnings").alias("rows_with_warnings"), *parts,
    )
    return out.select("file", F.to_json(whole).alias("report"))

"""Registered queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, sequences
from .functions.simplex import over
from .operators import audit, fits, joins, panels, scores, sequence_tables, signals
from .operators.quantiles import quantiles
from .plans import evaluate, forecast, standins, windows
from .sources.shared import cut

Query = Callable[[SparkSession, str], DataFrame]
ORIGIN = date(1998, 1, 1)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.observations(spark, sf_dir)
    return rows.withColumn("branch", labels.branch_label("nextclade"))


def _forecast(model: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = forecast.MODELS[model](standins.window_counts(spark, sf_dir))
        return _rounded(found.select("window_id", "h", "branch", "value"))

    return run


def _fallback(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = standins.observations(spark, sf_dir)
        return rows.groupBy(labels.branch_label(mode).alias("branch")).agg(F.count("*").alias("n"))

    return run


def header_first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.headers(spark, sf_dir).select("obs_id", labels.first_date(F.col("header")).alias("first_date"))


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("header")
    rows = standins.headers(spark, sf_dir).select(
        "obs_id",
        labels.accession(h).alias("accession"),
        labels.clean_label(labels.field(h, 4), labels.NO_VALUE).alias("clade"),
        labels.clean_label(labels.field(h, 5), labels.NO_VALUE).alias("subclade"),
        labels.year_of(labels.field(h, 6), labels.field(h, 0)).alias("year"),
        labels.field(h, 11).alias("beyond"),
    )
    return rows


def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.coarse(spark, sf_dir)
    index = windows.bin_index(F.col("collection_date"), F.lit(ORIGIN))
    return rows.groupBy(index.alias("bin"), "branch").agg(F.count("*").alias("n"))


def bin_share_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.binned(_labelled(spark, sf_dir), ORIGIN).select("bin_start", "branch", "n", "share"))


def branch_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.binned(_labelled(spark, sf_dir), ORIGIN).select("branch", "branch_pos").distinct()


def bin_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.binned(standins.coarse(spark, sf_dir), ORIGIN)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = rows.groupBy("bin_start").pivot("branch", names).agg(F.sum("n"))
    return wide.select("bin_start", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n_" + c[0]) for c in names])


def lineitem_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_returnflag")
    return rows.groupBy(windows.bin_index(F.col("d"), F.lit(ORIGIN)).alias("bin"), F.col("l_returnflag").alias("branch")).agg(F.count("*").alias("n"))


def event_daily_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "events")
    daily = rows.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("branch")).agg(F.count("*").alias("n"))
    return _rounded(daily.withColumn("share", F.col("n") / F.sum("n").over(over("day"))))


def fasta_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.keep_first(standins.sequences(spark, sf_dir)).select("record_index", "header", "sha")


def fasta_filter_tag_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.prepare(standins.sequences(spark, sf_dir)).select("record_index", F.length("sequence").alias("length"))


def dup_groups_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.duplicate_groups(standins.sequences(spark, sf_dir))


def seq_sha_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.sequences(spark, sf_dir).select("record_index", sequences.derived_key(F.col("sequence"), "SEQ_").alias("query_id"))


def hash_shard_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.sequences(spark, sf_dir).select("record_index", sequences.hash_owner(F.col("header"), 7).alias("shard"))


def translate_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.fixed_sequences(spark, sf_dir).withColumn("nt", F.translate("sequence", "EINORSHLDU", "ACGTACGTAC"))
    return rows.select("record_index", "piece", *[sequences.translate(F.col("nt"), f).alias(f"frame{f}") for f in range(3)])


def consensus_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.consensus(standins.fixed_sequences(spark, sf_dir), "lang")


def position_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.diversity(standins.fixed_sequences(spark, sf_dir))


def hamming_to_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.fixed_sequences(spark, sf_dir)
    both = rows.join(F.broadcast(sequence_tables.consensus(rows, "lang")), "lang")  # a row for each language
    return both.select("record_index", "piece", sequences.hamming(F.col("sequence"), F.col("consensus")).alias("distance"))


def valid_residue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return standins.sequences(spark, sf_dir).select("record_index", sequences.valid_residues(s).alias("valid"), sequences.is_protein(s).alias("is_protein"))


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.sequences(spark, sf_dir).groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n"))


def nucleotide_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_tables.nucleotide_like(standins.sequences(spark, sf_dir))


def audit_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(standins.observations(spark, sf_dir), ["subclade", "clade", "legacy"])


def audit_status_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.observations(spark, sf_dir).withColumns({"year": F.year("collection_date"), "priority": F.col("coarse")})
    return audit.status_by(rows, "subclade", "year", "priority", "legacy")


def audit_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.metric_summary(standins.observations(spark, sf_dir), "subclade", "score")


def audit_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_values(standins.observations(spark, sf_dir), ["subclade", "clade", "legacy"])


def audit_lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lineages(standins.observations(spark, sf_dir), "legacy", "subclade")


def audit_run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.observations(spark, sf_dir)
    runs = rows.select(
        F.col("legacy").alias("folder"), F.year("collection_date").alias("run"), (F.col("obs_id") % 997).alias("name"), F.col("obs_id").alias("line"), labels.label_status(F.col("subclade")).alias("status")
    )
    return audit.run_changes(runs)


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    words = ["", "Unable to align: alignment failed", "Unknown nucleotide in read", "gene is too short", "Unable to find start", "translation of gene S failed", "another problem", "  "]
    message = F.element_at(F.array(*[F.lit(w) for w in words]), k.cast("int") + 1)
    return audit.error_counts(standins.table(spark, sf_dir, "orders").select(message.alias("m")), "m")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated_names(standins.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name")), "name")


def cutoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = standins.cutoffs(spark)
    rows = standins.coarse(spark, sf_dir)
    counts = signals.branch_counts(rows, spans, "recent_start", "recent_end", "n").groupBy("window_id").agg(F.sum("n").alias("recent_instances"))
    year = signals.branch_counts(rows, spans, "annual_start", "annual_end", "n").groupBy("window_id").agg(F.sum("n").alias("annual_instances"))
    return spans.join(counts, "window_id", "left").join(year, "window_id", "left")


def window_aligned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.window_counts(spark, sf_dir)


def unique_accession_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = joins.unique_only(standins.observations(spark, sf_dir).withColumn("k", (F.col("obs_id") + 600) % 14500), "k")
    right = joins.unique_only(standins.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality"), "k")
    return left.join(right, "k").select("k", "obs_id", "quality")


def frozen_panel_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = standins.coarse(spark, sf_dir).groupBy("branch").agg(F.min("collection_date").alias("a"), F.max("collection_date").alias("b"))
    refs = refs.select("branch", F.explode(F.array("a", "b")).alias("reference_date"))
    return joins.frozen_panel(standins.cutoffs(spark).select("window_id", "forecast_cutoff"), refs)


def past_strain_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("collection_date"), F.col("o_custkey").alias("query_id"))
    return joins.past_without_current(rows, standins.cutoffs(spark)).groupBy("window_id").agg(F.count("*").alias("strains"), F.sum("source_weight").alias("weight"), F.max("last_seen").alias("last_seen"))


def instance_expansion_unique_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = standins.sequences(spark, sf_dir).withColumn("sequence", F.sha2(F.col("sequence").cast("binary"), 256))
    table = docs.withColumn("plain", F.regexp_replace("header", r"\|HA\||\|NA\|", "|"))
    records = docs.select(F.col("record_index").alias("record_id"), "header", F.concat(F.lit("doc"), (F.col("record_index") * 2).cast("string"), F.regexp_replace(F.col("header"), r"^doc[0-9]+(\|HA\||\|NA\|)", "|")).alias("plain"))
    done = docs.where(F.col("record_index") % 3 != 0).select("sequence")
    return joins.resolve_unique(records, [("header", table, "header"), ("plain", table, "plain")], done).groupBy("status").agg(F.count("*").alias("n"), F.count("sequence").alias("resolved"))


def metrics_six_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = standins.window_counts(spark, sf_dir)
    return _rounded(evaluate.metrics(evaluate.compared(counts, forecast.all_models(counts))))


def top1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = standins.window_counts(spark, sf_dir)
    return _rounded(evaluate.top1(evaluate.compared(counts, forecast.all_models(counts))))


def rolling_six_model_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.backtest(standins.window_counts(spark, sf_dir)))


def rolling_six_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.summary(evaluate.backtest(standins.window_counts(spark, sf_dir))))


def window_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.wins(evaluate.backtest(standins.window_counts(spark, sf_dir))))


def changepoint_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(forecast.change_points(standins.window_counts(spark, sf_dir))[1].select("window_id", "split", "change_score", "slope_norm", "regime_bins"))


def score_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading hundred of each branch, a top-k report."""
    rows = standins.coarse(spark, sf_dir)
    rank = F.row_number().over(over("branch").orderBy(F.desc("score"), "obs_id"))
    return rows.select("branch", "obs_id", "score", rank.alias("rank")).where("rank <= 100")


def score_ranking_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its rank."""
    return scores.ranked(standins.coarse(spark, sf_dir), "branch", "score", "obs_id").select("branch", "obs_id", "score", "rank")


def _partial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.observations(spark, sf_dir).select("obs_id", "collection_date", F.col("coarse").alias("branch"), "clade", F.col("legacy").alias("source"), F.when(F.col("obs_id") % 4 != 0, F.col("score")).alias("score"))


def score_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.completeness(_partial_scores(spark, sf_dir))


def score_summary_by_year_clade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.observations(spark, sf_dir).withColumn("year", F.year("collection_date"))
    rows = rows.select("year", F.col("year").alias("year_value"), labels.clean_label(F.col("clade"), labels.NO_VALUE).alias("clade"), "score")
    return _rounded(scores.by_year_and_clade(rows).withColumn("level", F.col("level").cast("int")), 4)


def score_by_date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.coarse(spark, sf_dir)
    index = windows.bin_index(F.col("collection_date"), F.lit(ORIGIN))
    binned = rows.withColumn("bin", index)
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    found = quantiles(binned, ["bin"], "score", {"q10": 0.1, "median": 0.5, "q90": 0.9}).drop("n")
    return _rounded(means.join(found, "bin"), 4)


def branch_signal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signals.score_signal(_partial_scores(spark, sf_dir), standins.cutoffs(spark)), 4)


def signal_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.score_signal(_partial_scores(spark, sf_dir), standins.cutoffs(spark))
    rows = rows.withColumns({"mean_score": F.round("mean_score", 6), "share_change": F.round("share_change", 9)})
    return _rounded(scores.correlations(rows, ["window_id"], "mean_score", "share_change"))


def signal_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.score_signal(_partial_scores(spark, sf_dir), standins.cutoffs(spark))
    return signals.leaders(rows, {"next_share": False, "previous_share": False, "mean_score": True}).join(signals.leaders(rows, {"mean_score": False}), "window_id")


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.coarse(spark, sf_dir)
    return rows.withColumn("distance", (F.col("obs_id") * 7919 % 1009) / 100.0)


def branch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distances(spark, sf_dir)
    return _rounded(signals.branch_features(rows, rows, standins.cutoffs(spark)), 4)


def distance_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distances(spark, sf_dir)
    return _rounded(signals.distance_signal(rows, rows, standins.cutoffs(spark)), 4)


#: References of a label: its first vectors, a panel of this size as pair scores have.
PANEL = 64


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = standins.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rank = F.row_number().over(over("label").orderBy("vec_id"))
    refs = e.withColumn("rank", rank).where(f"rank <= {PANEL}").select(F.col("vec_id").alias("reference_id"), "label", F.col("v").alias("r"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"))
    both = e.join(refs, "label")  # at most PANEL rows for each vector
    squares = F.zip_with("v", "r", lambda a, b: (a - b) * (a - b))
    distance = F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), 6)
    return both.select("label", F.col("vec_id").alias("query_id"), "reference_id", "weight", distance.alias("distance"))


def pair_weighted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.weighted_summary(_pairs(spark, sf_dir), ["query_id"], digits=6))


def score_resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = standins.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return scores.pending(work, standins.table(spark, sf_dir, "labels"), ["doc_id"])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distances(spark, sf_dir)
    return signals.branch_features(rows, rows, standins.cutoffs(spark))


def ridge_share_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.ridge_share_change(_features(spark, sf_dir)).select("window_id", "branch", F.round("predicted", 6).alias("predicted"), "train_windows", "status")


def _corrected(objective: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = cut(standins.window_counts(spark, sf_dir))
        base = forecast.count_renewal(counts).select("window_id", "h", "branch", F.col("value").alias("base"))
        actual = forecast.holdout(counts)
        if objective == "poisson":
            steps = base.join(actual.select("window_id", "h", "branch", F.col("n").cast("double").alias("observed")), ["window_id", "h", "branch"])
        else:
            share = F.col("base") / F.sum("base").over(over("window_id", "h"))
            steps = base.withColumn("base", share).join(actual.select("window_id", "h", "branch", "observed"), ["window_id", "h", "branch"])
        found = fits.corrected(steps, _features(spark, sf_dir), ("escape_excess", "fitness_excess"), objective)
        return found.select("window_id", "h", "branch", F.round("value", 5).alias("value"), "status")

    return run


def mlr_point_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fits.logistic_trend(standins.window_counts(spark, sf_dir), 12), 5)


def _strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents as strains with a date and a weight."""
    rows = standins.fixed_sequences(spark, sf_dir)
    day = F.date_add(F.lit(standins.TRAIN_START), (F.col("record_index") * 37 % 1500).cast("int"))
    key = F.col("record_index") * 100_000 + F.col("piece")
    return rows.select(key.alias("query_id"), "sequence", day.alias("date"), (1 + F.col("record_index") % 5).cast("double").alias("weight"))


def coreset_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panels.panel(_strains(spark, sf_dir), standins.cutoffs(spark), 30))


def past_strain_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different piece is a strain; it was observed wherever a document has it."""
    rows = _strains(spark, sf_dir).withColumn("query_id", F.xxhash64("sequence"))
    return _rounded(panels.past_panel(rows, standins.cutoffs(spark), 30))


def surrogate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.fixed_sequences(spark, sf_dir)
    return rows.join(scores.scored(rows), "sequence").select("record_index", "piece", F.round("score", 6).alias("score"))


def count_trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(forecast.trend_features(standins.window_counts(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "label_fallback_nextclade": _fallback("nextclade"),
    "label_fallback_legacy": _fallback("legacy"),
    **{f"forecast_{m.lower().replace('-', '_')}": _forecast(m) for m in forecast.MODELS if m != "CPS"},
    "forecast_changepoint": _forecast("CPS"),
    **{f"c_b2_correction_{o}": _corrected(o) for o in ("top1", "distribution", "poisson")},
}
for _f in (
    header_first_date, header_fields, bin_counts, bin_share_dense, branch_first_seen_order, bin_counts_pivot, lineitem_bin_counts, event_daily_bins,
    fasta_dedup_keep_first, fasta_filter_tag_length, dup_groups_audit, seq_sha_identity, hash_shard_owner, translate_codons, consensus_by_position,
    position_diversity, hamming_to_consensus, valid_residue_count, length_distribution, nucleotide_detection, audit_status_counts, audit_status_by,
    audit_metric_summary, audit_top_values, audit_lineage_table, audit_run_transitions, error_categories, repeated_keys, cutoff_table,
    window_aligned_counts, unique_accession_join, frozen_panel_inequality, past_strain_antijoin, instance_expansion_unique_hit, metrics_six_model,
    top1_accuracy, rolling_six_model_detail, rolling_six_model_summary, window_wins, changepoint_diagnostics, score_ranking, score_ranking_all, score_completeness,
    score_summary_by_year_clade, score_by_date_bin, branch_signal_window, signal_correlations, signal_leaders, branch_features, distance_signal,
    pair_weighted_summary, score_resume_antijoin, ridge_share_change, mlr_point_forecast, coreset_panel, past_strain_panel, surrogate_scores, count_trend_features,
):
    QUERIES[_f.__name__] = _f

"""Registered queries of evaluation variants, rolling fits, score tables, checked joins and file formats."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, sequences
from .functions.alignment import project
from .functions.simplex import over
from .operators import fits, joins, posterior, scores, signals
from .plans import evaluate, forecast, standins, windows
from .queries import ORIGIN, _distances, _features, _partial_scores, _rounded
from .sources import fasta, shared, tables
from .sources.shared import cut
from .streaming import bins

Query = Callable[[SparkSession, str], DataFrame]
CUTOFF = date(2000, 6, 30)
HORIZON = 12
LOOKBACK = 26
THRESHOLD = 5.0


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(windows.binned(standins.coarse(spark, sf_dir), ORIGIN).select("bin_start", "branch", "n", "share"))


def history_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.history_slice(_dense(spark, sf_dir), CUTOFF, HORIZON, LOOKBACK))


def single_cutoff_three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.single_cutoff(_dense(spark, sf_dir), CUTOFF, HORIZON)
    return _rounded(evaluate.metrics(evaluate.compared(counts, forecast.all_models(counts, forecast.SHARE_MODELS))).drop("window_id"))


def count_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(standins.window_counts(spark, sf_dir).repartition("window_id"))
    return _rounded(evaluate.count_metrics(counts, forecast.all_models(counts, forecast.COUNT_MODELS)), 5)


def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(standins.window_counts(spark, sf_dir).repartition("window_id"))
    return _rounded(evaluate.horizon_metrics(counts, forecast.all_models(counts)))


def changepoint_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = evaluate.backtest(standins.window_counts(spark, sf_dir), ("C-B2", "CPS"))
    return _rounded(evaluate.compared_models(detail, "C-B2", "CPS"))


def _trend(counts: DataFrame) -> DataFrame:
    found = fits.logistic_trend(counts, HORIZON + 1).where("status = 'ok'")
    return found.select(F.lit("MLR").alias("model"), "window_id", "h", "branch", "value")


def rolling_seven_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = standins.window_counts(spark, sf_dir)
    return _rounded(evaluate.standings(evaluate.merged(counts, _trend(counts))), 5)


def growth_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth advantages of all branches in all windows, sampled, with bands and convergence."""
    draws = cut(posterior.posterior_draws(standins.window_counts(spark, sf_dir)))
    return _rounded(posterior.growth_advantages(draws), 3)


def window_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = standins.window_counts(spark, sf_dir)
    excluded = standins.cutoffs(spark).where("target_start between '1998-01-01' and '1998-12-31'")
    return signals.window_overview(signals.without_windows(counts, excluded))


def ridge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fits.change_metrics(fits.ridge_share_change(_features(spark, sf_dir))), 5)


def gated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.gated(_features(spark, sf_dir), THRESHOLD)
    return _rounded(found.select("window_id", "branch", "gated_fitness_excess", "escape_fitness_interaction"), 2)


CORRECTIONS = {"": (), " + escape": ("escape_excess",), " + fitness": ("fitness_excess",), " + both": ("escape_excess", "fitness_excess"), " + gated": ("escape_excess", "gated_fitness_excess")}


def _steps(counts: DataFrame, base: DataFrame) -> DataFrame:
    share = F.col("value") / F.sum("value").over(over("window_id", "h"))
    return base.select("window_id", "h", "branch", share.alias("base")).join(forecast.holdout(counts).select("window_id", "h", "branch", "observed"), ["window_id", "h", "branch"])


def _biology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(signals.gated(_features(spark, sf_dir), THRESHOLD))


def _corrected_metrics(counts: DataFrame, rows: DataFrame) -> DataFrame:
    compared = evaluate.compared(counts, rows.select("model", "window_id", "h", "branch", "value"))
    return evaluate.metrics(compared).join(evaluate.top1(compared), ["model", "window_id"])


def correction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bases with five sets of features each, on the same windows."""
    counts = cut(standins.window_counts(spark, sf_dir).repartition("window_id"))
    biology, out = _biology(spark, sf_dir), None
    for name, base in (("C-B2", forecast.count_renewal(counts)), ("MLR", _trend(counts))):
        own = fits.corrected_sets(cut(_steps(counts, base)), biology, {name + k: v for k, v in CORRECTIONS.items()})
        out = own if out is None else out.unionByName(own)
    return _rounded(evaluate.standings(_corrected_metrics(counts, cut(out))), 4)


def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected counts bent by features: error and likelihood of each set."""
    counts = cut(standins.window_counts(spark, sf_dir).repartition("window_id"))
    base = forecast.count_renewal(counts).select("window_id", "h", "branch", F.col("value").alias("base"))
    steps = base.join(forecast.holdout(counts).select("window_id", "h", "branch", F.col("n").cast("double").alias("observed")), ["window_id", "h", "branch"])
    rows = fits.corrected_sets(cut(steps), _biology(spark, sf_dir), {"C-B2" + k: v for k, v in CORRECTIONS.items()}, "poisson")
    found = evaluate.count_metrics(counts, rows.drop("observed")).groupBy("model")
    return _rounded(found.agg(F.count("*").alias("windows"), *[F.avg(c).alias(c) for c in ("count_mae", "count_rmse", "mean_poisson_nll")]), 3)


def correction_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the full set by window, a column for each feature."""
    counts = cut(standins.window_counts(spark, sf_dir))
    columns = CORRECTIONS[" + both"]
    found = fits.corrected(_steps(counts, forecast.count_renewal(counts)), _features(spark, sf_dir), columns, weights=True)
    return _rounded(found.groupBy("window_id").pivot("feature", list(columns)).agg(F.first("coefficient")), 4)


TREND_SETS = {
    "offset": (),
    "offset + antigenicity": ("escape_excess", "bio_available"),
    "offset + fitness": ("fitness_excess", "bio_available"),
    "offset + biology": ("escape_excess", "fitness_excess", "escape_fitness_interaction", "bio_available"),
    "offset + counts + biology": ("log_recent_count", "log_count_growth", "composition_slope", "escape_excess", "fitness_excess", "escape_fitness_interaction", "bio_available"),
}


def trend_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the whole horizon from the C-B2 share and sets of count and biology features, on the windows before."""
    counts = cut(standins.window_counts(spark, sf_dir).repartition("window_id"))
    base = forecast.count_renewal(counts).groupBy("window_id", "branch").agg(F.sum("value").alias("value"))
    truth = forecast.holdout(counts).groupBy("window_id", "branch").agg(F.sum("n").alias("n"))
    part = over("window_id")
    rows = base.join(truth, ["window_id", "branch"]).select(
        "window_id", "branch", F.log(F.col("value") / F.sum("value").over(part) + 1e-12).alias("offset"), (F.col("n") / F.greatest(F.sum("n").over(part), F.lit(1))).alias("observed")
    )
    rows = rows.join(forecast.trend_features(counts), ["window_id", "branch"])
    rows = signals.with_features(rows, _biology(spark, sf_dir), ("escape_excess", "fitness_excess", "escape_fitness_interaction"))
    found = fits.rolling_sets(rows, TREND_SETS, floors={"escape_excess": 0.0})
    error = F.col("value") - F.col("observed")
    by_window = found.groupBy("model", "window_id").agg(F.avg(F.abs(error)).alias("mae"), (F.sum(F.abs(error)) / 2).alias("tvd"))
    return _rounded(by_window.groupBy("model").agg(F.count("*").alias("windows"), F.avg("mae").alias("mae"), F.avg("tvd").alias("tvd")), 4)


def composition_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The straight way between the branch shares of two years."""
    rows = standins.coarse(spark, sf_dir)
    ends = []
    for year in (1996, 2000):
        counts = rows.where(F.year("collection_date") == year).groupBy("branch").agg(F.count("*").alias("n"))
        ends.append(counts.select("branch", (F.col("n") / F.sum("n").over(over())).alias("share")))
    return _rounded(signals.bridge(*ends, 4))


def collapsed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in which branches of fewer than 200 records in the history are one."""
    rows = standins.observations(spark, sf_dir).select("collection_date", F.col("legacy").alias("branch")).where("branch <> 'MACHINERY' or day(collection_date) = 1")
    counts = windows.aligned_counts(rows, standins.half_years(spark), standins.TRAIN_START)
    return fits.collapsed(counts, 200).groupBy("window_id", "branch").agg(F.sum("n").alias("n"))


def score_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _partial_scores(spark, sf_dir).withColumns({"length": F.length("source").cast("double"), "raw": F.col("obs_id") / 7.0})
    return _rounded(scores.overview(rows, "score", "length", "raw", time="collection_date"), 4)


def signal_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(signals.score_signal(_partial_scores(spark, sf_dir), standins.cutoffs(spark)))
    leaders = signals.leaders(rows, {"next_share": False, "previous_share": False, "mean_score": True}).join(signals.leaders(rows, {"mean_score": False}), "window_id")
    rows = rows.withColumns({"mean_score": F.round("mean_score", 6), "share_change": F.round("share_change", 9)})
    found = scores.correlations(rows, ["window_id"], "mean_score", "share_change")
    return _rounded(signals.signal_overview(found, leaders, "high_next_share", ("high_previous_share", "high_mean_score", "low_mean_score")), 5)


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("record_index"), F.col("o_custkey").alias("query_id"), F.to_date("o_orderdate").alias("collection_date"), F.col("o_totalprice").alias("distance"))


def annual_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.annual_work(_instances(spark, sf_dir), standins.cutoffs(spark))


def cutoff_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of repeated queries by cutoff, held against the instances wanted there."""
    spans = standins.cutoffs(spark)
    rows = signals._in_range(_instances(spark, sf_dir), spans, "annual_start", "annual_end")
    means = scores.once_each(rows, ["window_id", "query_id"], "distance").where("window_id <> 3 or query_id % 5 <> 0")
    means = means.withColumns({"panel_size": F.lit(64), "scored_at": F.date_add(F.lit(standins.TRAIN_START), F.col("window_id"))})
    wanted = scores.annual_work(_instances(spark, sf_dir), spans).groupBy("window_id").agg(F.count("*").alias("instances"))
    return _rounded(scores.coverage(means, wanted, "distance"), 4)


def query_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.sequences(spark, sf_dir).withColumn("query_id", sequences.derived_key(F.col("sequence"), "Q_"))
    known = rows.where("record_index % 3 = 0").select(F.sha2(F.col("sequence").cast("binary"), 256).alias("sequence"), F.concat(F.lit("E"), F.col("record_index").cast("string")).alias("embedding_id"))
    return scores.registry(rows.withColumn("sequence", F.sha2(F.col("sequence").cast("binary"), 256)), known)


def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.value_sets(standins.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")
    return found.groupBy("n_values", "one_value").agg(F.count("*").alias("n"))


def customer_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with how often they ordered, each once on both sides; null where they never did."""
    counts = joins.occurrences(_instances(spark, sf_dir), "query_id")
    people = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), "c_mktsegment")
    return joins.checked_join(people, counts, ["query_id"], "left", "one_to_one")


def complete_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its customer's segment: many to one, none missing."""
    people = standins.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), "c_mktsegment")
    return joins.complete_join(_instances(spark, sf_dir), people, ["query_id"], "c_mktsegment").select("record_index", "c_mktsegment")


def many_to_many_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of a nation, counted by nation; those without a partner are dropped."""
    left = standins.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k"), "s_suppkey").agg(F.count("*").alias("n"))
    right = standins.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg(F.count("*").alias("m"))
    return joins.checked_join(left, right, ["k"], "inner", "many_to_many").groupBy("k", "c_mktsegment").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))


def verified_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and scores of one index that must agree on the sequence's hash."""
    rows = standins.sequences(spark, sf_dir).select("record_index", F.sha2(F.col("sequence").cast("binary"), 256).alias("sha"))
    scored = standins.sequences(spark, sf_dir).select("record_index", F.sha2(F.col("sequence").cast("binary"), 256).alias("sha"), F.length("sequence").alias("valid_length"))
    return joins.agreeing_join(rows, scored, ["record_index"], ["sha"])


def seeded_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work table that gets the keys it lacks, and which of them are pending."""
    held = standins.table(spark, sf_dir, "labels").select("doc_id", F.lit("held").alias("origin"))
    new = standins.table(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("origin"))
    return scores.seeded(held, new, ["doc_id"])


def audit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = standins.headers(spark, sf_dir).select(labels.audit_fields(F.col("header")).alias("f"))
    return found.groupBy("f.subtype", "f.lineage", "f.year").agg(F.count("*").alias("n"))


def canonical_label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labels of the form A to D, alone or before a point, by branch column."""
    rows = standins.observations(spark, sf_dir)
    named = rows.withColumn("label", F.concat_ws(".", F.substring("legacy", 1, 1), F.substring("subclade", 1, 1)))
    return _rounded(named.groupBy("clade").agg(F.avg(F.col("label").rlike(r"^[A-D](\.|$)").cast("int")).alias("canonical")))


def index_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three shards each record belongs to by its index, and the records of each."""
    rows = standins.sequences(spark, sf_dir)
    return rows.groupBy(F.pmod("record_index", F.lit(3)).alias("shard")).agg(F.count("*").alias("n"), F.min("record_index").alias("first"))


def ambiguous_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.letter_records(spark, sf_dir)
    letters = rows.select(F.explode(sequences.ambiguous_letters(F.col("sequence"))).alias("letter"))
    return letters.where("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


def fixed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.letter_records(spark, sf_dir)
    return rows.select("record_index", F.sha2(sequences.fixed_slice(F.col("sequence")).cast("binary"), 256).alias("sha"))


def frame_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.fixed_sequences(spark, sf_dir).withColumn("nt", F.translate("sequence", "EINORSHLDU", "ACGTACGTAC"))
    found = rows.select("record_index", "piece", sequences.frame_candidates(F.col("nt"), 5).alias("c"))
    return found.select("record_index", "piece", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("first"))


def aligned_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers' nations aligned onto one of them; each different one once."""
    names = standins.table(spark, sf_dir, "customer").join(standins.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = names.select(F.concat("c_mktsegment", "n_name").alias("sequence"))
    return rows.groupBy("sequence").agg(F.count("*").alias("n")).join(project(rows, "MACHINERYUNITED STATES"), "sequence")


def _letters_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared.folder(spark, "fasta")
    fasta.write_fasta(standins.letter_records(spark, sf_dir), path)
    return path


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a sequence file and read again."""
    found = fasta.read_fasta(spark, _letters_file(spark, sf_dir))
    return found.groupBy("header", F.length("sequence").alias("length"), F.sha2(F.col("sequence").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("n"))


def fasta_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.folder(spark, "shards")
    fasta.write_shards(standins.letter_records(spark, sf_dir), path, 5)
    return spark.read.text(path).where("value like '>%'").groupBy("shard").agg(F.count("*").alias("n"))


def fasta_two_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fasta.read_two_lines(spark, _letters_file(spark, sf_dir))
    return found.agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("letters"), F.countDistinct("header").alias("headers"))


def fasta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First records of the sequences that labelled documents have."""
    rows = standins.letter_records(spark, sf_dir)
    wanted = rows.join(standins.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_index")), "record_index")
    return fasta.lookup(rows, wanted).select("record_index", "header", F.length("sequence").alias("length"))


def isolate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of 15 fields, some with blanks around them."""
    o = standins.observations(spark, sf_dir)
    some = [F.concat(F.lit(" "), F.col("legacy")), F.concat(F.lit("EPI_ISL_"), F.col("obs_id").cast("string")), *[F.lit("x")] * 4, F.date_format("collection_date", "yyyy-MM-dd"), *[F.lit("y ")] * 8]
    found = fasta.isolate_headers(o.select(F.concat_ws("|", *some).alias("header")))
    return found.groupBy("virus_name", "collection_date", "submitter").agg(F.count("*").alias("n"))


def annotations_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation table written, found again in its folder, and counted by day and branch."""
    path = shared.folder(spark, "annotations")
    rows = standins.headers(spark, sf_dir).join(standins.observations(spark, sf_dir), "obs_id")
    rows = rows.select(F.col("header").alias("seqName"), "subclade", "clade", F.col("legacy").alias("legacy-clade"), F.col("score").cast("string").alias("unused"))
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    found = tables.read_annotations(spark, path)
    return found.groupBy("collection_date", "branch").agg(F.count("*").alias("n"))


def csv_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard tables written, two columns read again, and keys counted that an earlier row has."""
    path = shared.folder(spark, "csv")
    rows = standins.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    tables.write_csv(rows, path)
    found, repeated = tables.merge_shards(spark, path, {"l_orderkey": "long", "l_quantity": "double"}, "l_orderkey")
    return found.agg(F.sum("l_quantity").cast("long").alias("quantity")).crossJoin(repeated)  # one row each


def partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose partitions of two keys are replaced by a second write."""
    path = shared.folder(spark, "upsert")
    rows = standins.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.lit(1).alias("version"))
    tables.write_partitioned(rows, path, "priority")
    again = rows.where("priority in ('1-URGENT', '5-LOW') and o_orderkey % 2 = 0").withColumn("version", F.lit(2))
    for _ in range(2):
        tables.write_partitioned(again, path, "priority")
    found = spark.read.schema("o_orderkey long, version int, priority string").parquet(path)
    return found.groupBy("priority", "version").agg(F.count("*").alias("n"))


def with_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = standins.table(spark, sf_dir, "labels").select("doc_id")
    return tables.with_files(standins.table(spark, sf_dir, "documents").select("doc_id"), listing, "doc_id")


def stream_event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in bins of a day: the state of all bins after the last batch, written to the shared folder."""
    name = shared.folder(spark, "stream")
    schema = standins.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if sf_dir.startswith("/") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    counts = bins.stream_bins(events, "ts", "event_type", ORIGIN, 1)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/bins")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{name}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{name}/bins")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        history_slice, single_cutoff_three_models, count_metrics, horizon_metrics, changepoint_comparison, rolling_seven_model_summary, growth_posterior, window_overview,
        ridge_metrics, gated_features, correction_summary, correction_counts, correction_coefficients, trend_feature_sets, composition_bridge,
        collapsed_counts, score_overview, signal_overview, annual_work, cutoff_coverage, query_registry, value_conflicts, customer_occurrences,
        complete_scores, many_to_many_pairs, verified_zip, seeded_work, audit_headers, canonical_label_share, index_shard, ambiguous_letters, fixed_slices,
        frame_candidates, aligned_headers, fasta_round_trip, fasta_shards, fasta_two_line, fasta_lookup, isolate_fields, annotations_round_trip,
        csv_shards, partition_upsert, with_listed_files, stream_event_bins,
    )
}

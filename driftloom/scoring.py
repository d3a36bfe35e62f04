"""Registered queries of score stores, pair panels, numbered files, table audits, strain labels, alignments and late streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extended_oracles import _SPANS
from .functions import sequences
from .functions.alignment import project
from .operators import joins, pairs, sequence_tables, strains, table_audit
from .oracles import _FIXED, _HDR, _SEQ
from .plans import standins
from .queries import _rounded
from .sources import fasta, shared
from .sources.store import ScoreStore, striped
from .streaming import bins

Query = Callable[[SparkSession, str], DataFrame]
ORIGIN = date(1998, 1, 1)


def score_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seeded without a score, two batches that share a cutoff, one of them twice, an older batch, and a guarded update."""
    store = ScoreStore(spark, shared.folder(spark, "store"), ["cutoff", "query_id"], "scored_at", {"table": "orders"}, buckets=8)
    rows = standins.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cutoff"), F.col("o_orderkey").alias("query_id"), "o_totalprice")
    scored = lambda k, at, by: rows.where(f"query_id % {k} = 0").select("cutoff", "query_id", (F.col("o_totalprice") * by).alias("score"), F.lit(at).alias("scored_at"))
    store.seed(rows.select("cutoff", "query_id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("scored_at")))
    store.upsert(scored(2, 1, 1.0))
    store.upsert(scored(3, 3, 2.0))
    store.upsert(scored(6, 2, 5.0))
    store.upsert(scored(3, 3, 2.0))
    store.update(scored(5, 9, 3.0), lambda old, new: old["score"].isNull())
    return store.read().withColumn("score", F.round("score", 4))


def striped_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, in the order of their length and id, dealt to seven workers."""
    left = standins.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(standins.table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return striped(left, ["n_chars", "doc_id"], 7).select("doc_id", "place", "worker")


def pair_panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each recent half-year against all vectors of the five years before it, weighted."""
    e = standins.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.date_add(F.lit(standins.TRAIN_START), (F.col("vec_id") * 37 % 2400).cast("int")).alias("day"))
    spans = standins.cutoffs(spark).select("window_id", "recent_start", "recent_end", F.add_months("recent_end", -60).alias("past_start"))
    # a row for each window
    near = e.join(F.broadcast(spans), F.col("day").between(F.col("past_start"), F.col("recent_end")))
    key = F.col("window_id").cast("string").alias("key")
    queries = near.where("day >= recent_start").select(key, F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    panel = near.where("day < recent_start").select(key, F.col("vec_id").alias("reference_id"), (1 + F.col("vec_id") % 3).alias("weight"), F.col("embedding").alias("v"))
    found = pairs.summaries(queries, panel).select(F.col("key").cast("int").alias("window_id"), *[F.col(c) for c in ("query_id", "mean", "p50", "p10", "p90", "least", "most", "panel_size")])
    return _rounded(found)


def _ordered_file(spark: SparkSession, sf_dir: str) -> str:
    path = shared.folder(spark, "numbered")
    fasta.write_fasta(standins.letter_records(spark, sf_dir).orderBy("record_index"), path)
    return path


def fasta_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a file in parts with their numbers over all parts, and the shard of each number."""
    found = fasta.read_fasta(spark, _ordered_file(spark, sf_dir))
    return found.select("record_index", "header", F.pmod("record_index", F.lit(3)).alias("shard"), F.length("sequence").alias("length"))


def fasta_first_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first hundred records of a file are nucleotides."""
    return sequence_tables.nucleotide_like(fasta.read_two_lines(spark, _ordered_file(spark, sf_dir)))


def fasta_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a file beside the rows of a table, by place; header and place must agree."""
    records = fasta.read_fasta(spark, _ordered_file(spark, sf_dir)).select("record_index", "header", F.length("sequence").alias("letters"))
    rows = standins.sequences(spark, sf_dir).join(standins.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_index"), "n_chars"), "record_index")
    rows = striped(rows.select("record_index", F.translate("header", " ", "_").alias("header"), "n_chars"), ["record_index"], 1)
    return joins.agreeing_join(records, rows.select(F.col("place").cast("long").alias("record_index"), "header", "n_chars"), ["record_index"], ["header"])


def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of the audit of an annotation table that was written as text."""
    path = shared.folder(spark, "audit")
    rows = standins.headers(spark, sf_dir).join(standins.observations(spark, sf_dir), "obs_id")
    errors = F.when(F.col("obs_id") % 8 == 1, "Unable to align: alignment failed").when(F.col("obs_id") % 8 == 2, "translation of gene S failed").when(F.col("obs_id") % 8 == 3, "other").otherwise("")
    rows = rows.select(
        F.col("header").alias("seqName"), F.col("subclade").alias("clade"), F.col("legacy").alias("legacy-clade"), F.when(F.col("obs_id") % 3 == 0, "good").otherwise("").alias("qc.overallStatus"),
        (F.col("obs_id") % 100).cast("string").alias("qc.overallScore"), errors.alias("errors"), F.when(F.col("obs_id") % 16 == 1, "w").otherwise("").alias("warnings"),
    )
    rows.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    found = table_audit.counters(spark, path, "*.csv")
    return found.groupBy("section", "field", "value", "status").agg(F.sum("n").alias("n"))


def strain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strains of each recent half-year with their mean distance to all isolates of the half-year after it."""
    rows = standins.fixed_sequences(spark, sf_dir)
    day = F.date_add(F.lit(standins.TRAIN_START), (F.col("record_index") * 37 % 2400).cast("int"))
    records = rows.select((F.col("record_index") * 100_000 + F.col("piece")).alias("record_id"), "sequence", day.alias("day"), F.concat(F.lit("EPI_"), F.col("record_index").cast("string"), F.lit("_"), F.floor(F.col("piece") / 2).cast("string")).alias("accession"), (F.col("piece") % 2 * 1.5).alias("quality"))
    # the isolates and the strains are read more than once
    best = shared.written(strains.isolates(records, "quality", "record_id").select("record_id", "sequence", "day"), "isolates")
    spans = standins.cutoffs(spark)
    within = lambda first, last: best.join(F.broadcast(spans.select("window_id", first, last)), F.col("day").between(F.col(first), F.col(last)))
    candidates = within("recent_start", "recent_end").groupBy("window_id", "sequence").agg(F.min("record_id").alias("strain_id"), F.count("*").alias("isolates"))
    later = within("target_start", "target_end").select("window_id", "sequence")
    found = strains.later_distance(shared.written(candidates, "strains"), later)
    return _rounded(found.select("window_id", "strain_id", "compared", "mean_distance", "isolates"), 6)


def aligned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all texts, aligned onto the first one."""
    rows = standins.fixed_sequences(spark, sf_dir).select("sequence")
    first = rows.agg(F.min("sequence")).first()[0]
    return project(rows, first) if first else rows.withColumn("projected", F.col("sequence"))


def late_event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with a watermark, each once: the bins that are final when the stream has been read, added to a table."""
    where = shared.folder(spark, "late")
    schema = standins.table(spark, sf_dir, "events").schema
    events = standins.table(spark, sf_dir, "events")
    # the stream reads files of its own: a part of the events comes twice, in a second file
    events.unionByName(events.where("event_id % 5 = 0")).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(schema).parquet(f"{where}/in")
    counts = bins.stream_bins(stream, "ts", "event_type", ORIGIN, 1, "2 days", "event_id")
    query = counts.writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{where}/out")


def checked_query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different text by its derived key, of which none stands for two texts."""
    rows = standins.sequences(spark, sf_dir)
    keyed = rows.select(sequences.derived_key(F.col("sequence"), "Q_").alias("query_id"), F.sha2(F.col("sequence").cast("binary"), 256).alias("sha"))
    return joins.one_value_each(keyed, "query_id", "sha")


def references_before_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions (customer and priority) of one subtype, dated before each cutoff, of customers that have an embedding."""
    o = standins.table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    refs = o.select("o_custkey", "o_orderpriority", F.col("o_custkey").alias("embedding_id"), F.when(F.col("o_orderkey") % 3 == 0, "H3N2").otherwise(" h1n1").alias("subtype"), day.alias("reference_date"))
    held = standins.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("embedding_id"))
    found = joins.references_before(refs, standins.cutoffs(spark), ["o_custkey", "o_orderpriority"], held, "H1N1")
    return found.select("window_id", "o_custkey", "o_orderpriority", "reference_date")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        score_store_upsert, striped_pending, pair_panel_summary, fasta_numbers, fasta_first_hundred, fasta_positional_zip, audit_counters, strain_labels, aligned_pieces, late_event_bins,
        checked_query_keys, references_before_cutoffs,
    )
}

_LETTERS = f"""{_SEQ}, records as (
    select row_number() over (order by record_index) - 1 as place, record_index, replace(header, ' ', '_') as header, regexp_replace(sequence, '[^A-Z]', '', 'g') as letters from seqs
)"""
_KIND = "case when {0} = '' then 'blank' when lower({0}) = 'unassigned' then 'unassigned' else 'assigned' end"
_PART = "coalesce(nullif(trim(split_part(header, '|', {0})), ''), 'unknown')"

ORACLE_SQL: dict[str, str] = {
    "checked_query_keys": f"with {_SEQ} select distinct 'Q_' || substr(sha256(sequence), 1, 20) as query_id, sha256(sequence) as sha from seqs",
    "references_before_cutoffs": f"""
        with {_SPANS}, r as (
            select o_custkey, o_orderpriority, min(cast(o_orderdate as date)) as reference_date from orders
            where o_orderkey % 7 <> 0 and o_orderkey % 3 <> 0 and o_custkey in (select vec_id from embeddings) group by all
        ) select window_id, o_custkey, o_orderpriority, reference_date from r join spans on reference_date < forecast_cutoff""",
    "score_store_upsert": """
        select o_orderpriority as cutoff, o_orderkey as query_id,
               case when o_orderkey % 3 = 0 then round(o_totalprice * 2, 4) when o_orderkey % 2 = 0 then round(o_totalprice, 4) when o_orderkey % 5 = 0 then round(o_totalprice * 3, 4) end as score,
               case when o_orderkey % 3 = 0 then 3 when o_orderkey % 2 = 0 then 1 when o_orderkey % 5 = 0 then 9 else 0 end as scored_at
        from orders""",
    "striped_pending": """
        with p as (select doc_id, row_number() over (order by n_chars, doc_id) - 1 as place from documents anti join labels using (doc_id))
        select doc_id, place, cast(place % 7 as integer) as worker from p""",
    "pair_panel_summary": f"""
        with {_SPANS}, e as (select vec_id, cast(date '1995-01-01' + to_days(cast(vec_id * 37 % 2400 as integer)) as date) as day, [x::double for x in embedding] as v from embeddings),
        q as (select * from e join spans on day between recent_start and recent_end),
        r as (select vec_id, v, window_id, 1 + vec_id % 3 as w from e join spans on day < recent_start and day >= cast(recent_end - interval 60 month as date)),
        p as (select q.window_id, q.vec_id as q, r.vec_id as ref, r.w, round(sqrt(list_sum([(q.v[i] - r.v[i]) * (q.v[i] - r.v[i]) for i in range(1, len(q.v) + 1)])), 6) as x from q join r using (window_id)),
        c as (select *, sum(w) over (partition by window_id, q order by x, ref rows unbounded preceding) as cum, sum(w) over (partition by window_id, q) as total from p)
        select window_id, q as query_id, cast((2 * sum(w * cast(round(x * 1000000) as bigint)) + sum(w)) // (2 * sum(w)) as bigint) / 1000000.0 as mean, min(case when cum >= 0.5 * total - 1e-12 then x end) as p50,
               min(case when cum >= 0.1 * total - 1e-12 then x end) as p10, min(case when cum >= 0.9 * total - 1e-12 then x end) as p90, min(x) as least, max(x) as most, count(*) as panel_size
        from c group by window_id, q""",
    "fasta_numbers": f"with {_LETTERS} select place as record_index, header, place % 3 as shard, cast(length(letters) as integer) as length from records",
    "fasta_first_hundred": f"""
        with {_LETTERS}, f as (select letters from records where place < 100)
        select cast(sum(length(regexp_replace(letters, '[^ACGTUN]', '', 'g'))) as bigint) as nucleotide_letters, cast(sum(length(letters)) as bigint) as letters,
               coalesce(sum(length(regexp_replace(letters, '[^ACGTUN]', '', 'g'))) / nullif(sum(length(letters)), 0) >= 0.97, false) as is_nucleotide from f""",
    "fasta_positional_zip": f"with {_LETTERS} select place as record_index, header, cast(length(letters) as integer) as letters, n_chars from records join documents on doc_id = record_index",
    "late_event_bins": """
        select cast(ts as date) as bin_start, event_type as branch, count(*) as n from events
        where cast(ts as date) + interval 1 day <= (select max(ts) - interval 2 day from events) group by all""",
    "audit_counters": f"""
        with {_HDR}, t as (
            select header, subclade, legacy, {_KIND.format('subclade')} as p, obs_id,
                   case obs_id % 8 when 1 then 'alignment_error' when 2 then 'translation_error' when 3 then 'other' end as error, obs_id % 16 = 1 as warned,
                   case when obs_id % 17 = 0 or obs_id % 19 = 0 then strftime(collection_date + interval 30 day, '%Y') else strftime(collection_date, '%Y') end as year, obs_id % 17 = 0 as odd
            from obs join hdr using (obs_id)
        )
        select 'rows' as section, '' as field, '' as value, p as status, count(*) as n from t group by all
        union all select 'name', '', header, '', count(*) from t group by all
        union all select 'messages', 'errors', '', '', count(*) from t where error is not null having count(*) > 0
        union all select 'messages', 'warnings', '', '', count(*) from t where warned having count(*) > 0
        union all select 'messages', 'either', '', p, count(*) from t where error is not null or warned group by all
        union all select 'error', '', error, '', count(*) from t where error is not null group by all
        union all select 'quality', '', case when obs_id % 3 = 0 then 'good' else 'blank' end, p, count(*) from t group by all
        union all select 'year', '', case when odd then '2020' else year end, p, count(*) from t group by all
        union all select 'lineage', '', {_PART.format(6)}, p, count(*) from t group by all
        union all select 'subtype', '', {_PART.format(3)}, p, count(*) from t group by all
        union all select 'assignment', 'clade', '', p, count(*) from t group by all
        union all select 'assignment', 'legacy-clade', '', {_KIND.format('legacy')}, count(*) from t group by all
        union all select 'value', 'clade', case when subclade = '' then '<blank>' else subclade end, p, count(*) from t group by all
        union all select 'value', 'legacy-clade', legacy, p, count(*) from t group by all
        union all select 'metric', 'qc.overallScore', (obs_id % 100)::double::varchar, p, count(*) from t group by all""",
    "strain_labels": f"""
        with {_SPANS}, {_FIXED}, records as (
            select record_index * 100000 + piece as record_id, sequence, cast(date '1995-01-01' + to_days(cast(record_index * 37 % 2400 as integer)) as date) as day, record_index, piece // 2 as pair, piece % 2 as quality from fixed
        ), best as (
            select * from records qualify row_number() over (partition by record_index, pair order by quality desc, record_id) = 1
        ), candidates as (
            select window_id, sequence, min(record_id) as strain_id, count(*) as isolates from best join spans on day between recent_start and recent_end group by all
        ), later as (
            select window_id, sequence, count(*) as n from best join spans on day between target_start and target_end group by all
        )
        select c.window_id, strain_id, any_value(isolates) as isolates, cast(sum(n) as bigint) as compared, round(sum(n * hamming(c.sequence, l.sequence)) / sum(n), 6) as mean_distance
        from candidates c join later l using (window_id) group by c.window_id, strain_id""",
}

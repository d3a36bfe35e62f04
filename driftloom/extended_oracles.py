"""DuckDB SQL with the rows of the queries in ``extended``."""

from __future__ import annotations

from .oracles import _ALL, _BRANCH, _COARSE, _COUNTS, _CPS, _DIST, _FIXED, _HDR, _MODELS, _OBS, _PAST, _RANKED, _SEQ, _SIGNAL, _SPANS, _frame

_DENSE = f"""{_COARSE}, cells as (
    select cast(floor(datediff('day', date '1998-01-01', d) / 14.0) as integer) as b, branch, count(*) as n from coarse where d >= date '1998-01-01' group by all
), dense as (
    select g.b, k.branch, coalesce(n, 0) as n from (select cast(unnest(range(min(b), max(b) + 1)) as integer) as b from cells) g cross join (select distinct branch from cells) k
    left join cells c on c.b = g.b and c.branch = k.branch
), sliced as (
    select *, b - cast(floor(datediff('day', date '1998-01-01', date '2000-06-30') / 14.0) as integer) as step, coalesce(n / nullif(sum(n) over (partition by b), 0), 0) as share from dense
)"""
#: The count table of one window around a cutoff, in place of that of all windows.
_ONE = f"""{_DENSE}, counts as (
    select 0 as window_id, step - 1 as bin, branch, n from (select *, sum(n) over (partition by b) as total from sliced) where step <= 12 and total > 0
)"""
_STEPS = """joined as (
    select model, f.window_id, f.h, f.branch, n, observed, first, value, sum(value) over (partition by model, f.window_id, f.h) as total
    from forecasts f join held using (window_id, h, branch) join (select window_id, branch, observed as first from held where h = 1) using (window_id, branch)
), compared as (
    select model, window_id, h, branch, observed, case when total > 0 then value / total else first end as predicted from joined
), by_step as (
    select model, window_id, h, sum(abs(predicted - observed)) as a, sum(pow(predicted - observed, 2)) as s, count(*) as k,
           0.5 * sum(observed * ln((observed + 1e-12) / ((observed + predicted) / 2 + 1e-12)) + predicted * ln((predicted + 1e-12) / ((observed + predicted) / 2 + 1e-12))) as j
    from compared group by all
), metrics as (
    select model, window_id, sum(a) / sum(k) as mae, sqrt(sum(s) / sum(k)) as rmse, avg(a / 2) as mean_tvd, avg(j) as mean_jsd, count(*) as bins from by_step group by all
)"""


def _models(counts: str, *names: str) -> str:
    """The CTEs of some models over a count table, and ``forecasts``."""
    own = {n: n.lower().replace("-", "_") for n in names}
    ctes = [_CPS if n == "CPS" else _MODELS[n] for n in names]
    return counts + _PAST[len(_COUNTS) :] + ", " + ", ".join(ctes) + ", forecasts as (" + " union all ".join(f"select * from {x}" for x in own.values()) + ")"


_FEATURES = f"""{_DIST}, r as (
    select window_id, branch, count(*) as scored_sequences, avg(distance) as mean_distance, avg(score) as mean_fitness from dist join spans on d between recent_start and recent_end group by all
), y as (
    select window_id, avg(distance) as yd, avg(score) as yf from dist join spans on d between annual_start and annual_end group by all
), cs as (
    select window_id, branch, count(*) / sum(count(*)) over (partition by window_id) as current_share from dist join spans on d between recent_start and recent_end group by window_id, branch
), fs as (
    select window_id, branch, count(*) / sum(count(*)) over (partition by window_id) as next_share from dist join spans on d between target_start and target_end group by window_id, branch
), features as (
    select window_id, branch, mean_distance, coalesce(current_share, 0) as c, coalesce(next_share, 0) as nx, coalesce(next_share, 0) - coalesce(current_share, 0) as y,
           mean_distance - yd as e, mean_fitness - yf as f
    from r join y using (window_id) left join cs using (window_id, branch) left join fs using (window_id, branch) where scored_sequences >= 10
)"""
#: Ridge by its normal equations: features less their mean and over their spread, a penalty of 1, three features by Cramer's rule.
_RIDGE = f"""{_FEATURES}, moments as (
    select t.window_id, count(*) as n, count(distinct p.window_id) as trained, avg(p.y) as my, avg(p.c) as mc, avg(p.e) as me, avg(p.f) as mf,
           coalesce(nullif(stddev_pop(p.c), 0), 1) as sc, coalesce(nullif(stddev_pop(p.e), 0), 1) as se, coalesce(nullif(stddev_pop(p.f), 0), 1) as sf,
           var_pop(p.c) as vc, var_pop(p.e) as ve, var_pop(p.f) as vf, covar_pop(p.c, p.e) as ce, covar_pop(p.c, p.f) as cf, covar_pop(p.e, p.f) as ef,
           covar_pop(p.c, p.y) as cy, covar_pop(p.e, p.y) as ey, covar_pop(p.f, p.y) as fy
    from (select distinct window_id from features) t join features p on p.window_id < t.window_id group by t.window_id
), system as (
    select *, n * vc / sc / sc + 1 as a11, n * ve / se / se + 1 as a22, n * vf / sf / sf + 1 as a33, n * ce / sc / se as a12, n * cf / sc / sf as a13, n * ef / se / sf as a23,
           n * cy / sc as b1, n * ey / se as b2, n * fy / sf as b3 from moments
), solved as (
    select *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) as det,
           b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3) as d1,
           a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13) as d2,
           a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13) as d3
    from system
), ridge as (
    select features.*, coalesce(trained, 0) as trained,
           case when trained >= 3 and n > 3 then my + d1 / det * (features.c - mc) / sc + d2 / det * (features.e - me) / se + d3 / det * (features.f - mf) / sf end as predicted
    from features left join solved using (window_id)
)"""
_LETTERS = f"{_SEQ}, recs as (select record_index, header, regexp_replace(sequence, '[^A-Z]', '', 'g') as sequence from seqs)"
_INST = "inst as (select o_orderkey as record_index, o_custkey as query_id, cast(o_orderdate as date) as d, o_totalprice as distance from orders)"

ORACLE_SQL: dict[str, str] = {
    "history_slice": f"with {_DENSE} select cast(date '1998-01-01' + to_days(cast(14 * b as integer)) as date) as bin_start, branch, n, round(share, 6) as share, step from sliced where step between -25 and 12",
    "single_cutoff_three_models": f"""with {_models(_ONE, 'F-B0', 'F-B1', 'F-B2')}, {_STEPS}
        select model, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mean_tvd, 6) as mean_tvd, round(mean_jsd, 6) as mean_jsd, bins from metrics""",
    "count_metrics": f"""with {_models(_COUNTS, 'C-B0', 'C-B1', 'C-B2')}, m as (select model, window_id, n, greatest(value, 1e-12) as mu from forecasts join held using (window_id, h, branch))
        select model, window_id, round(avg(abs(mu - n)), 5) as count_mae, round(sqrt(avg(pow(mu - n, 2))), 5) as count_rmse, round(avg(mu - n * ln(mu) + lgamma(n + 1)), 5) as mean_poisson_nll from m group by all""",
    "horizon_metrics": f"""with {_ALL}, m as (select model, window_id, branch, sum(n) as n, sum(value) as v from forecasts join held using (window_id, h, branch) group by all),
        s as (select model, window_id, branch, n / sum(n) over w as o, v / sum(v) over w as p from m window w as (partition by model, window_id))
        select model, window_id, round(avg(abs(p - o)), 6) as mae, round(sqrt(avg(pow(p - o, 2))), 6) as rmse, round(sum(abs(p - o)) / 2, 6) as tvd,
               round(0.5 * sum(o * ln((o + 1e-12) / ((o + p) / 2 + 1e-12)) + p * ln((p + 1e-12) / ((o + p) / 2 + 1e-12))), 6) as jsd,
               case when first(branch order by round(o, 9) desc, branch) = first(branch order by round(p, 9) desc, branch) then 1.0::double else 0.0::double end as top1_accuracy
        from s group by all""",
    "changepoint_comparison": f"""with {_models(_COUNTS, 'C-B2', 'CPS')}, {_STEPS}
        select window_id, round(a.mean_tvd, 6) as one, round(b.mean_tvd, 6) as two, round(b.mean_tvd - a.mean_tvd, 6) as difference
        from (select * from metrics where model = 'C-B2') a join (select * from metrics where model = 'CPS') b using (window_id)""",
    "window_overview": f"""with {_COUNTS} select window_id, count(distinct case when bin < 0 then bin end) as history_bins, count(distinct case when bin >= 0 then bin end) as holdout_bins,
        cast(sum(case when bin >= 0 then n else 0 end) as bigint) as holdout_records from counts where n > 0 and window_id not in (2, 3) group by window_id""",
    "ridge_share_change": f"""with {_RIDGE} select window_id, branch, round(predicted, 6) as predicted, cast(trained as integer) as train_windows,
        case when predicted is null then 'too few earlier windows' else 'ok' end as status from ridge""",
    "ridge_metrics": f"""with {_RIDGE}, p as (select * from ridge where predicted is not null),
        k as (select *, rank() over (order by round(predicted, 9)) + (count(*) over (partition by round(predicted, 9)) - 1) / 2.0 as rx, rank() over (order by round(y, 9)) + (count(*) over (partition by round(y, 9)) - 1) / 2.0 as ry from p),
        h as (select window_id, first(branch order by round(c + predicted, 9) desc, branch) = first(branch order by round(nx, 9) desc, branch) as hit from p group by window_id)
        select count(*) as n_rows, count(distinct window_id) as cutoffs, round(avg(abs(predicted - y)), 5) as share_change_mae, round(corr(rx, ry), 5) as spearman, (select cast(count_if(hit) as bigint) from h) as top1_hits from k""",
    "gated_features": f"with {_FEATURES} select window_id, branch, round(case when mean_distance > 5.0 then f else 0.0 end, 2) as gated_fitness_excess, round(greatest(e, 0) * f, 2) as escape_fitness_interaction from features",
    "composition_bridge": f"""with {_COARSE}, s as (select year(d) as y, branch, count(*) / sum(count(*)) over (partition by year(d)) as share from coarse where year(d) in (1996, 2000) group by year(d), branch),
        b as (select branch, coalesce(a.share, 0) as a, coalesce(z.share, 0) as z from (select * from s where y = 1996) a full join (select * from s where y = 2000) z using (branch))
        select cast(h as integer) as h, branch, round(a + (z - a) * h / 4, 6) as share from b cross join (select unnest(range(1, 5)) as h)""",
    "collapsed_counts": f"""with {_SPANS}, {_OBS}, c as (select window_id, cast(floor(datediff('day', s, collection_date) / 14.0) as integer) as bin, legacy as branch, count(*) as n
            from obs join windows on collection_date >= date '1995-01-01' and datediff('day', s, collection_date) < 14 * ((datediff('day', s, e) + 1) // 14) where legacy <> 'MACHINERY' or day(collection_date) = 1 group by all),
        t as (select window_id, branch, sum(case when bin < 0 then n else 0 end) as total, sum(n) as n from c group by all), k as (select window_id, count_if(total >= 200) as stay from t group by all)
        select window_id, case when total < 200 and stay >= 2 then 'other' else branch end as branch, cast(sum(n) as bigint) as n from t join k using (window_id) group by all""",
    "score_overview": f"""with {_OBS}, p as (select *, case when obs_id % 4 <> 0 then score end as s, length(legacy)::double as l, obs_id / 7.0 as r from obs)
        select count(*) as n, round(min(s), 4) as min_score, round(max(s), 4) as max_score, round(avg(s), 4) as mean_score, min(l) as min_length, max(l) as max_length, round(avg(l), 4) as mean_length,
               round(min(r), 4) as min_raw, round(max(r), 4) as max_raw, round(avg(r), 4) as mean_raw, min(collection_date) as first_collection_date, max(collection_date) as last_collection_date from p""",
    "signal_overview": f"""with {_SIGNAL}{_RANKED}, c as (select window_id, corr(x, y) as p, corr(rx, ry) as s from ranked group by window_id),
        a as (select window_id, first(branch order by round(next_share, 9) desc, branch) as n, first(branch order by round(previous_share, 9) desc, branch) as p from changed group by window_id),
        b as (select window_id, first(branch order by round(mean_score, 9), branch) as lo, first(branch order by round(mean_score, 9) desc, branch) as hi from changed where mean_score is not null group by window_id),
        l as (select * from a join b using (window_id))
        select round(avg(p), 5) as mean_pearson, round(avg(s), 5) as mean_spearman, count(*) as windows, (select cast(count_if(p = n) as bigint) from l) as high_previous_share_hits,
               (select cast(count_if(hi = n) as bigint) from l) as high_mean_score_hits, (select cast(count_if(lo = n) as bigint) from l) as low_mean_score_hits from c""",
    "annual_work": f"""with {_SPANS}, {_INST}, h as (select window_id, query_id, d as collection_date, record_index, count(*) over (partition by window_id, query_id) as n from inst join spans on d between annual_start and annual_end)
        select * from h qualify row_number() over (partition by window_id, query_id order by collection_date desc, record_index desc) = 1""",
    "cutoff_coverage": f"""with {_SPANS}, {_INST}, m as (select window_id, query_id, avg(distance) as x from inst join spans on d between annual_start and annual_end group by all),
        w as (select window_id, count(*) as instances from m group by all), k as (select * from m where window_id <> 3 or query_id % 5 <> 0)
        select window_id, count(*) as summaries, count(distinct query_id) as queries, 64 as panel_size, round(avg(x), 4) as mean, round(quantile_cont(x, 0.1), 4) as p10, round(quantile_cont(x, 0.9), 4) as p90,
               cast(date '1995-01-01' + to_days(window_id) as date) as scored_at, any_value(instances) as instances, count(*) = any_value(instances) as complete from k join w using (window_id) group by window_id""",
    "query_registry": f"""with {_SEQ}, r as (select record_index, sequence, 'Q_' || substr(sha256(sequence), 1, 20) as query_id from seqs), f as (select * from r qualify row_number() over (partition by query_id order by record_index) = 1),
        k as (select sequence, min('E' || record_index) as held from r where record_index % 3 = 0 group by sequence)
        select query_id, record_index, coalesce(held, query_id) as embedding_id, case when held is not null then 'reused' else 'new' end as embedding_source from f left join k using (sequence)""",
    "value_conflicts": """with s as (select l_orderkey, count(distinct l_returnflag) as n_values, min(l_returnflag) as m from lineitem group by all)
        select n_values, case when n_values = 1 then m end as one_value, count(*) as n from s group by all""",
    "customer_occurrences": "select c_custkey as query_id, c_mktsegment, n as source_weight from customer left join (select o_custkey, count(*) as n from orders group by all) on o_custkey = c_custkey",
    "complete_scores": "select o_orderkey as record_index, c_mktsegment from orders join customer on o_custkey = c_custkey",
    "many_to_many_pairs": "select s_nationkey as k, c_mktsegment, count(*) as pairs from supplier join customer on s_nationkey = c_nationkey group by all",
    "verified_zip": f"with {_SEQ} select record_index, sha256(sequence) as sha, cast(length(sequence) as integer) as valid_length from seqs",
    "seeded_work": "select doc_id, 'held' as origin from labels union all select distinct doc_id, 'new' from documents where doc_id not in (select doc_id from labels)",
    "audit_headers": f"""with {_HDR}, p as (select coalesce(nullif(trim(split_part(header, '|', 3)), ''), 'unknown') as subtype, coalesce(nullif(trim(split_part(header, '|', 6)), ''), 'unknown') as lineage,
            coalesce(nullif(regexp_extract(header, '(?:^|\\|)((?:19|20)[0-9][0-9])-[0-9][0-9]-[0-9][0-9](?:\\||$)', 1), ''), 'unknown') as year from hdr)
        select subtype, lineage, year, count(*) as n from p group by all""",
    "canonical_label_share": f"with {_OBS} select clade, round(avg(case when regexp_matches(substr(legacy, 1, 1) || '.' || substr(subclade, 1, 1), '^[A-D](\\.|$)') then 1 else 0 end), 6) as canonical from obs group by clade",
    "index_shard": "select doc_id % 3 as shard, count(*) as n, min(doc_id) as first from documents group by all",
    "ambiguous_letters": f"with {_LETTERS}, l as (select unnest(string_split(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), '')) as letter from recs) select letter, count(*) as n from l where letter <> '' group by all",
    "fixed_slices": f"with {_LETTERS} select record_index, sha256(substr(sequence, 18, 327)) as sha from recs",
    "frame_candidates": f"""with {_FIXED}, t as (select record_index, piece, translate(sequence, 'EINORSHLDU', 'ACGTACGTAC') as nt from fixed), f as (select record_index, piece, {_frame(0)}, {_frame(1)}, {_frame(2)} from t),
        c as (select record_index, piece, list_sort(list_distinct(list_filter([frame0, frame1, frame2], lambda x: length(x) >= 5 and not contains(x, '*')))) as c from f)
        select record_index, piece, cast(len(c) as integer) as n, c[1] as first from c""",
    "fasta_round_trip": f"with {_LETTERS} select replace(header, ' ', '_') as header, cast(length(sequence) as integer) as length, sha256(sequence) as sha, count(*) as n from recs group by all",
    "fasta_shards": f"""with {_LETTERS}, d as (select sha256(header) as s from recs)
        select cast(list_reduce(list_prepend(0::bigint, [cast(('0x' || substr(s, 1 + 4 * i, 4)) as bigint) for i in range(16)]), lambda a, x: (a * 65536 + x) % 5) as integer) as shard, count(*) as n from d group by 1""",
    "fasta_two_line": f"with {_LETTERS} select count(*) as n, cast(sum(length(sequence)) as bigint) as letters, count(distinct replace(header, ' ', '_')) as headers from recs",
    "fasta_lookup": f"""with {_LETTERS}, f as (select * from recs where sequence in (select sequence from recs where record_index in (select doc_id from labels)) qualify row_number() over (partition by sequence order by record_index) = 1)
        select record_index, header, cast(length(sequence) as integer) as length from f""",
    "isolate_fields": f"with {_OBS} select legacy as virus_name, collection_date, 'y' as submitter, count(*) as n from obs group by all",
    "annotations_round_trip": f"""with {_HDR}, r as (select try_strptime(nullif(regexp_extract(header, '(?:^|[^0-9])((?:19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])(?:[^0-9]|$)', 1), ''), '%Y-%m-%d')::date as collection_date, {_BRANCH} as branch
            from hdr join obs using (obs_id)) select collection_date, branch, count(*) as n from r group by all""",
    "csv_shards": """with c as (select l_orderkey, count(*) as n from lineitem group by all)
        select (select cast(sum(l_quantity) as bigint) from lineitem) as quantity, cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as repeated from c""",
    "partition_upsert": """select o_orderpriority as priority, case when o_orderpriority in ('1-URGENT', '5-LOW') then 2 else 1 end as version, count(*) as n from orders
        where o_orderpriority not in ('1-URGENT', '5-LOW') or o_orderkey % 2 = 0 group by all""",
    "with_listed_files": "select doc_id, doc_id in (select doc_id from labels) as file_exists from documents",
    "stream_event_bins": "select cast(ts as date) as bin_start, event_type as branch, count(*) as n from events group by all",
}

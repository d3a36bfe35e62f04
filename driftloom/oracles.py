"""DuckDB SQL with the rows of the registered queries, written independently of the plans."""

from __future__ import annotations

_OBS = """obs as (
    select o_orderkey as obs_id, cast(o_orderdate as date) as collection_date,
           case when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then 'Unassigned' else n_name end as subclade,
           case when o_orderkey % 7 = 0 then 'unknown' else r_name end as clade,
           c_mktsegment as legacy, o_orderpriority as coarse, o_totalprice as score
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""
_CLEAN = "case when lower(trim({0})) not in ('', 'unassigned', 'unknown', 'nan', 'none', '<na>') then trim({0}) end"
_FIELD = "case when lower(trim({0})) not in ('', 'unassigned', 'unknown', 'none', 'na', 'n/a', 'null', '-') then trim({0}) end"


def _label(*columns: str) -> str:
    return "coalesce(" + ", ".join(_CLEAN.format(c) for c in columns) + ", 'Unassigned')"


_BRANCH = _label("subclade", "clade", "legacy")
_STATUS = "case when trim(coalesce({0}, '')) = '' then 'blank' when lower(trim({0})) = 'unassigned' then 'unassigned' else 'assigned' end"
_BIN = "cast(floor(datediff('day', date '1998-01-01', {0}) / 14.0) as integer)"
_HDR = f"""{_OBS}, hdr as (
    select obs_id, concat_ws('|', 'A/' || legacy || '/' || obs_id || '/' || year(collection_date), 'EPI_ISL_' || obs_id, 'H1N1', legacy, clade, subclade,
               case when obs_id % 17 = 0 then '2020-13-45' when obs_id % 19 = 0 then '' else strftime(collection_date, '%Y-%m-%d') end,
               strftime(collection_date + interval 30 day, '%Y-%m-%d')) as header
    from obs
)"""
_SEQ = """seqs as (
    select doc_id as record_index, 'doc' || doc_id || case when doc_id % 5 = 0 then '|NA|' else '|HA|' end || lang || '|' || source as header, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as sequence
    from documents
)"""
_FIXED = """letters as (
    select doc_id, lang, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g') as letters from documents
), pieces as (
    select doc_id, lang, letters, cast(unnest(range(length(letters) // 64)) as integer) as piece from letters
), fixed as (
    select doc_id as record_index, piece, lang, substr(letters, piece * 64 + 1, 64) as sequence from pieces
)"""
_SPANS = """windows as (
    select i as window_id, cast(date '1997-01-01' + to_months(6 * i) as date) as s, cast(date '1997-01-01' + to_months(6 * i + 6) - interval 1 day as date) as e
    from (select cast(unnest(range(9)) as integer) as i)
), spans as (
    select window_id, cast(s - interval 1 day as date) as forecast_cutoff, cast(s - interval 6 month as date) as recent_start, cast(s - interval 1 day as date) as recent_end,
           cast(s - interval 12 month as date) as annual_start, cast(s - interval 1 day as date) as annual_end,
           cast(s - interval 12 month as date) as previous_half_start, cast(s - interval 6 month - interval 1 day as date) as previous_half_end,
           s as target_start, e as target_end
    from windows
)"""
_COARSE = "coarse as (select o_orderkey as obs_id, cast(o_orderdate as date) as d, o_orderpriority as branch, o_totalprice as score from orders)"
_COUNTS = f"""{_SPANS}, {_COARSE}, cells as (
    select window_id, cast(floor(datediff('day', s, d) / 14.0) as integer) as bin, branch, count(*) as n
    from coarse join windows on d >= date '1995-01-01' and datediff('day', s, d) < 14 * ((datediff('day', s, e) + 1) // 14)
    group by all
), counts as (
    select b.window_id, b.bin, k.branch, coalesce(c.n, 0) as n
    from (select distinct window_id, bin from cells) b join (select distinct window_id, branch from cells) k using (window_id)
    left join cells c on c.window_id = b.window_id and c.bin = b.bin and c.branch = k.branch
)"""
_PAST = f"""{_COUNTS}, totals as (
    select window_id, bin, sum(n) as total from counts group by all
), past as (
    select window_id, bin, branch, n, total, n / total as p, cast(dense_rank() over (partition by window_id order by bin desc) - 1 as integer) as t
    from counts join totals using (window_id, bin) where bin < 0
), look as (
    select *, max(t) over (partition by window_id) + 1 as len, max(t) over (partition by window_id) - t as x from past where t < 26
), held as (
    select window_id, branch, n, n / total as observed, cast(dense_rank() over (partition by window_id order by bin) as integer) as h
    from counts join totals using (window_id, bin) where bin >= 0
), steps as (
    select distinct window_id, h from held
), seen as (
    select window_id, branch from look group by all having sum(n) > 0
), level as (
    select window_id, greatest(median(total), 1.0) as level from (select distinct window_id, bin, total, t from past) where t < 4 group by window_id
), every as (
    select distinct window_id, branch from past
), smooth as (
    select look.*, ln((n + 0.5) / (total + 0.5 * count(*) over (partition by window_id, bin)))
           - avg(ln((n + 0.5) / (total + 0.5 * k))) over (partition by window_id, bin) as z
    from (select look.*, count(*) over (partition by window_id, bin) as k from look semi join seen using (window_id, branch)) look
)"""
_MODELS = {
    "F-B0": "f_b0 as (select 'F-B0' as model, window_id, h, branch, p as value from past join steps using (window_id) where t = 0)",
    "F-B1": """f_b1_fit as (
    select window_id, branch, any_value(len) as len, max(case when t = 0 then p end) as anchor,
           (sum(w) * sum(w * x * p) - sum(w * x) * sum(w * p)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) as slope, sum(w) as s, sum(w * x) as sx, sum(w * p) as sp
    from (select *, pow(0.5 + 0.5 * x / (len - 1), 2) as w from look) group by window_id, branch
), f_b1_raw as (
    select window_id, h, branch, anchor, greatest((sp - slope * sx) / s + slope * (len + h - 1), 0) as raw from f_b1_fit join steps using (window_id)
), f_b1 as (
    select 'F-B1' as model, window_id, h, branch,
           case when sum(raw) over (partition by window_id, h) > 0 then raw / sum(raw) over (partition by window_id, h) else anchor end as value
    from f_b1_raw
)""",
    "F-B2": """f_b2_z as (
    select *, ln(p + 1e-6) - avg(ln(p + 1e-6)) over (partition by window_id, bin) as z from look semi join seen using (window_id, branch)
), f_b2_fit as (
    select window_id, branch, greatest(least(median(g), 0.35), -0.35) as growth, max(case when t = 0 then p end) as last_p
    from (select *, z - lag(z) over (partition by window_id, branch order by bin) as g from f_b2_z) group by window_id, branch
), f_b2_soft as (
    select window_id, h, branch, exp(ln(last_p + 1e-6) + h * growth) as u from f_b2_fit join steps using (window_id)
), f_b2 as (
    select 'F-B2' as model, e.window_id, s.h, e.branch, coalesce(u / sum(u) over (partition by e.window_id, s.h), 0) as value
    from every e join steps s using (window_id) left join f_b2_soft f on f.window_id = e.window_id and f.h = s.h and f.branch = e.branch
)""",
    "C-B0": "c_b0 as (select 'C-B0' as model, window_id, h, branch, cast(n as double) as value from past join steps using (window_id) where t = 0)",
    "C-B1": """c_b1_fit as (
    select window_id, branch, any_value(len) as len, sum(total) as s, sum(total * x) as sx, sum(total * z) as sz,
           (sum(total) * sum(total * x * z) - sum(total * x) * sum(total * z)) / (sum(total) * sum(total * x * x) - sum(total * x) * sum(total * x)) as slope
    from smooth group by window_id, branch
), c_b1_soft as (
    select window_id, h, branch, exp((sz - slope * sx) / s + slope * (len + h - 1)) as u from c_b1_fit join steps using (window_id)
), c_b1 as (
    select 'C-B1' as model, e.window_id, s.h, e.branch, coalesce(u / sum(u) over (partition by e.window_id, s.h), 0) * level as value
    from every e join steps s using (window_id) join level using (window_id) left join c_b1_soft f on f.window_id = e.window_id and f.h = s.h and f.branch = e.branch
)""",
    "C-B2": """c_b2_g as (
    select window_id, branch, sum(w * g) / sum(w) as growth from (
        select window_id, branch, z - lag(z) over o as g, sqrt(least(total, lag(total) over o)) * (0.25 + 0.75 * (x - 1) / (len - 2)) as w
        from smooth window o as (partition by window_id, branch order by bin)
    ) where g is not null group by window_id, branch
), c_b2_soft as (
    select window_id, h, branch, exp(ln((n + 0.5) / sum(n + 0.5) over (partition by window_id, h)) + h * greatest(least(growth, 0.35), -0.35)) as u
    from (select * from smooth where t = 0) join c_b2_g using (window_id, branch) join steps using (window_id)
), c_b2 as (
    select 'C-B2' as model, e.window_id, s.h, e.branch, coalesce(u / sum(u) over (partition by e.window_id, s.h), 0) * level as value
    from every e join steps s using (window_id) join level using (window_id) left join c_b2_soft f on f.window_id = e.window_id and f.h = s.h and f.branch = e.branch
)""",
}
_CPS = """cps_k as (
    select past.*, count(*) over (partition by window_id, bin) as k from past semi join (select window_id, branch from past group by all having sum(n) > 0) using (window_id, branch)
), cps_z as (
    select window_id, bin, branch, t, ln((n + 0.5) / (total + 0.5 * k)) - avg(ln((n + 0.5) / (total + 0.5 * k))) over (partition by window_id, bin) as z from cps_k
), state as (
    select *, max(t) over (partition by window_id) + 1 as len, max(t) over (partition by window_id) - t as x from cps_z where t < 26
), moved as (
    select *, avg(z) over (partition by window_id, branch order by x rows between 5 preceding and 1 preceding) as before,
           avg(z) over (partition by window_id, branch order by x rows between current row and 4 following) as after
    from state
), scored as (
    select window_id, x, round(sqrt(sum(pow(after - before, 2))), 9) as score from moved where x >= 5 and x <= len - 5 group by window_id, x
), chosen as (
    select window_id, score, x from scored qualify row_number() over (partition by window_id order by score desc, x) = 1
), lengths as (
    select window_id, any_value(len) as len from state group by window_id
), splits as (
    select window_id, coalesce(score, 0.0) as change_score, cast(case when score >= 0.35 then x else 0 end as integer) as split from lengths left join chosen using (window_id)
), regime as (
    select state.*, pow(0.92, len - 1 - x) as w from state join splits using (window_id) where x >= split
), slopes as (
    select window_id, branch, max(case when t = 0 then z end) as last_z, count(*) as bins,
           (sum(w * x * z) - sum(w * x) * sum(w * z) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w) + 1.0) as raw
    from regime group by window_id, branch
), capped as (
    select *, raw * least(1, 0.18 / sqrt(sum(raw * raw) over (partition by window_id))) as slope, least(sqrt(sum(raw * raw) over (partition by window_id)), 0.18) as norm from slopes
), cps_soft as (
    select window_id, h, branch, exp(last_z + (1 - pow(0.85, h)) / 0.15 * slope) as u from capped join steps using (window_id)
), cps as (
    select 'CPS' as model, e.window_id, s.h, e.branch, coalesce(u / sum(u) over (partition by e.window_id, s.h), 0) as value
    from every e join steps s using (window_id) left join cps_soft f on f.window_id = e.window_id and f.h = s.h and f.branch = e.branch
)"""
_ALL = f"{_PAST}, " + ", ".join(_MODELS.values()) + ", forecasts as (" + " union all ".join(f"select * from {m.lower().replace('-', '_')}" for m in _MODELS) + ")"
_EVAL = f"""{_ALL}, joined as (
    select model, f.window_id, f.h, f.branch, observed, first, value, sum(value) over (partition by model, f.window_id, f.h) as total
    from forecasts f join held using (window_id, h, branch) join (select window_id, branch, observed as first from held where h = 1) using (window_id, branch)
), compared as (
    select model, window_id, h, branch, observed, case when total > 0 then value / total else first end as predicted from joined
), by_step as (
    select model, window_id, h, sum(abs(predicted - observed)) as a, sum(pow(predicted - observed, 2)) as s, count(*) as k,
           0.5 * sum(observed * ln((observed + 1e-12) / ((observed + predicted) / 2 + 1e-12)) + predicted * ln((predicted + 1e-12) / ((observed + predicted) / 2 + 1e-12))) as j
    from compared group by all
), metrics as (
    select model, window_id, sum(a) / sum(k) as mae, sqrt(sum(s) / sum(k)) as rmse, avg(a / 2) as mean_tvd, avg(j) as mean_jsd, count(*) as bins from by_step group by all
), led as (
    select model, window_id, h, branch, row_number() over (partition by model, window_id, h order by round(observed, 9) desc, branch) as o,
           row_number() over (partition by model, window_id, h order by round(predicted, 9) desc, branch) as p
    from compared
), top1 as (
    select model, window_id, avg(case when p = 1 then 1.0 else 0.0 end) as top1_accuracy from led where o = 1 group by all
), detail as (
    select * from metrics join top1 using (model, window_id)
)"""
_DETAIL = "model, window_id, round(mae, 6) as mae, round(rmse, 6) as rmse, round(mean_tvd, 6) as mean_tvd, round(mean_jsd, 6) as mean_jsd, bins"
_PARTIAL = f"{_SPANS}, partial as (select o_orderkey as obs_id, cast(o_orderdate as date) as d, o_orderpriority as branch, case when o_orderkey % 4 <> 0 then o_totalprice end as score from orders)"
_SIGNAL = f"""{_PARTIAL}, before as (
    select window_id, branch, count(*) as previous_count from partial join spans on d between recent_start and recent_end group by all
), after as (
    select window_id, branch, count(*) as next_count from partial join spans on d between target_start and target_end group by all
), stats as (
    select window_id, branch, count(*) as scored, avg(score) as mean_score, median(score) as median_score, max(score) as max_score
    from partial join spans on d between recent_start and recent_end where score is not null group by all
), merged as (
    select window_id, branch, coalesce(previous_count, 0) as previous_count, coalesce(next_count, 0) as next_count, scored,
           case when scored >= 10 then mean_score end as mean_score, case when scored >= 10 then median_score end as median_score, case when scored >= 10 then max_score end as max_score
    from before full join after using (window_id, branch) full join stats using (window_id, branch)
), signal as (
    select *, previous_count / greatest(sum(previous_count) over (partition by window_id), 1) as previous_share,
           next_count / greatest(sum(next_count) over (partition by window_id), 1) as next_share
    from merged
), changed as (
    select *, next_share - previous_share as share_change from signal
)"""
_DIST = f"{_SPANS}, {_COARSE}, dist as (select *, (obs_id * 7919 % 1009) / 100.0 as distance from coarse)"
_WORDS = "['', 'Unable to align: alignment failed', 'Unknown nucleotide in read', 'gene is too short', 'Unable to find start', 'translation of gene S failed', 'another problem', '  ']"


def _audit(fields: list[str]) -> str:
    return " union all ".join(f"select '{f}' as field, trim(coalesce({f}, '')) as value, {_STATUS.format(f)} as status from obs" for f in fields)


_RANKED = """, pairs as (
    select window_id, round(mean_score, 6) as x, round(share_change, 9) as y from changed where mean_score is not null
), ranked as (
    select *, rank() over (partition by window_id order by x) + (count(*) over (partition by window_id, x) - 1) / 2.0 as rx,
           rank() over (partition by window_id order by y) + (count(*) over (partition by window_id, y) - 1) / 2.0 as ry
    from pairs
)"""

_CODONS = "map([" + ", ".join(f"'{a}{b}{c}'" for a in "TCAG" for b in "TCAG" for c in "TCAG") + "], ["
_CODONS += ", ".join(f"'{x}'" for x in "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG") + "])"


def _frame(f: int) -> str:
    letters = f"[coalesce({_CODONS}[substr(nt, {f} + 1 + 3 * i, 3)], 'X') for i in range((length(nt) - {f}) // 3)]"
    return f"regexp_replace(array_to_string({letters}, ''), '\\*$', '') as frame{f}"


ORACLE_SQL: dict[str, str] = {
    "label_fallback_nextclade": f"with {_OBS} select {_BRANCH} as branch, count(*) as n from obs group by all",
    "label_fallback_legacy": f"with {_OBS} select {_label('legacy', 'subclade', 'clade')} as branch, count(*) as n from obs group by all",
    "header_first_date": f"""with {_HDR} select obs_id, try_strptime(nullif(regexp_extract(header, '(?:^|[^0-9])((?:19|20)[0-9][0-9]-[0-9][0-9]-[0-9][0-9])(?:[^0-9]|$)', 1), ''), '%Y-%m-%d')::date as first_date from hdr""",
    "header_fields": f"""with {_HDR} select obs_id, nullif(regexp_extract(header, '\\|(EPI_ISL_[0-9]+)\\|', 1), '') as accession,
        {_FIELD.format("split_part(header, '|', 5)")} as clade, {_FIELD.format("split_part(header, '|', 6)")} as subclade,
        cast(coalesce(year(try_strptime(split_part(header, '|', 7), '%Y-%m-%d')), try_cast(list_last(regexp_extract_all(split_part(header, '|', 1), '((?:19|20)[0-9][0-9])', 1)) as integer)) as integer) as year,
        cast(null as varchar) as beyond from hdr""",
    "bin_counts": f"select {_BIN.format('cast(o_orderdate as date)')} as bin, o_orderpriority as branch, count(*) as n from orders group by all",
    "bin_share_dense": f"""with {_OBS}, r as (select {_BIN.format('collection_date')} as b, {_BRANCH} as branch from obs where collection_date >= date '1998-01-01'),
        c as (select b, branch, count(*) as n from r group by all), g as (select unnest(range(min(b), max(b) + 1)) as b from c),
        f as (select g.b, k.branch, coalesce(c.n, 0) as n from g cross join (select distinct branch from c) k left join c on c.b = g.b and c.branch = k.branch)
        select cast(date '1998-01-01' + to_days(cast(14 * b as integer)) as date) as bin_start, branch, n, round(coalesce(n / nullif(sum(n) over (partition by b), 0), 0), 6) as share from f""",
    "branch_first_seen_order": f"""with {_OBS}, r as (select collection_date, {_BRANCH} as branch from obs where collection_date >= date '1998-01-01'),
        s as (select branch, min(collection_date) as d from r group by all)
        select branch, cast(row_number() over (order by branch <> 'Unassigned', d, branch) as integer) as branch_pos from s""",
    "bin_counts_pivot": f"""with c as (select {_BIN.format('cast(o_orderdate as date)')} as b, o_orderpriority as p from orders where o_orderdate >= date '1998-01-01'),
        g as (select unnest(range(min(b), max(b) + 1)) as b from c)
        select cast(date '1998-01-01' + to_days(cast(14 * g.b as integer)) as date) as bin_start, count_if(p = '1-URGENT')::bigint as n_1, count_if(p = '2-HIGH')::bigint as n_2,
               count_if(p = '3-MEDIUM')::bigint as n_3, count_if(p = '4-NOT SPECIFIED')::bigint as n_4, count_if(p = '5-LOW')::bigint as n_5
        from g left join c on c.b = g.b group by g.b""",
    "lineitem_bin_counts": f"select {_BIN.format('cast(l_shipdate as date)')} as bin, l_returnflag as branch, count(*) as n from lineitem group by all",
    "event_daily_bins": "with c as (select cast(ts as date) as day, event_type as branch, count(*) as n from events group by all) select *, round(n / sum(n) over (partition by day), 6) as share from c",
    "fasta_dedup_keep_first": f"with {_SEQ} select record_index, header, sha256(sequence) as sha from seqs where sequence <> '' qualify row_number() over (partition by sequence order by record_index) = 1",
    "fasta_filter_tag_length": f"""with {_SEQ}, f as (select * from seqs where sequence <> '' qualify row_number() over (partition by sequence order by record_index) = 1)
        select record_index, cast(length(sequence) as integer) as length from f where header like '%|HA|%' and length(sequence) >= 560""",
    "dup_groups_audit": f"""with {_SEQ}, k as (select 'header' as kind, header as v from seqs union all select 'aligned', sequence from seqs union all select 'ungapped', replace(sequence, '-', '') from seqs),
        c as (select kind, v, count(*) as c from k group by all) select kind, cast(count_if(c > 1) as bigint) as groups, cast(sum(c - 1) as bigint) as extra_records from c group by kind""",
    "seq_sha_identity": f"with {_SEQ} select record_index, 'SEQ_' || substr(sha256(sequence), 1, 20) as query_id from seqs",
    "hash_shard_owner": f"""with {_SEQ}, d as (select record_index, sha256(header) as s from seqs)
        select record_index, cast(list_reduce(list_prepend(0::bigint, [cast(('0x' || substr(s, 1 + 4 * i, 4)) as bigint) for i in range(16)]), lambda a, x: (a * 65536 + x) % 7) as bigint) as shard from d""",
    "translate_codons": f"with {_FIXED}, t as (select record_index, piece, translate(sequence, 'EINORSHLDU', 'ACGTACGTAC') as nt from fixed) select record_index, piece, {_frame(0)}, {_frame(1)}, {_frame(2)} from t",
    "consensus_by_position": f"""with {_FIXED}, l as (select lang, unnest(range(64)) as pos, sequence from fixed), c as (select lang, pos, substr(sequence, pos + 1, 1) as letter, count(*) as n from l group by all),
        b as (select * from c qualify row_number() over (partition by lang, pos order by n desc, letter) = 1) select lang, string_agg(letter, '' order by pos) as consensus from b group by lang""",
    "position_diversity": f"""with {_FIXED}, l as (select unnest(range(64)) as pos, sequence from fixed)
        select cast(pos as integer) as pos, count(distinct substr(sequence, pos + 1, 1)) as letters, count(*) as n, count(distinct substr(sequence, pos + 1, 1)) = 1 as unchanged from l group by pos""",
    "hamming_to_consensus": f"""with {_FIXED}, l as (select record_index, piece, lang, unnest(range(64)) as pos, sequence from fixed), c as (select lang, pos, substr(sequence, pos + 1, 1) as letter, count(*) as n from l group by all),
        b as (select * from c qualify row_number() over (partition by lang, pos order by n desc, letter) = 1)
        select record_index, piece, cast(sum(case when substr(sequence, l.pos + 1, 1) <> letter then 1 else 0 end) as integer) as distance from l join b on b.lang = l.lang and b.pos = l.pos group by record_index, piece""",
    "valid_residue_count": f"""with {_SEQ} select record_index, cast(length(regexp_replace(sequence, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) as integer) as valid,
        regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWYXBZUOJ]+') as is_protein from seqs""",
    "length_distribution": f"with {_SEQ} select cast(length(sequence) as integer) as length, count(*) as n from seqs group by all",
    "nucleotide_detection": f"""with {_SEQ}, s as (select cast(sum(length(regexp_replace(sequence, '[^ACGTUN]', '', 'g'))) as bigint) as nucleotide_letters, cast(sum(length(sequence)) as bigint) as letters from seqs where record_index < 100)
        select *, coalesce(nucleotide_letters / letters >= 0.97, false) as is_nucleotide from s""",
    "audit_status_counts": f"with {_OBS} select field, status, count(*) as n from ({_audit(['subclade', 'clade', 'legacy'])}) group by all",
    "audit_status_by": f"""with {_OBS}, d as (select {_STATUS.format('subclade')} as status, 'year' as dimension, cast(year(collection_date) as varchar) as value from obs
        union all select {_STATUS.format('subclade')}, 'priority', coarse from obs union all select {_STATUS.format('subclade')}, 'legacy', legacy from obs)
        select dimension, value, status, count(*) as n from d group by all""",
    "audit_metric_summary": f"with {_OBS} select {_STATUS.format('subclade')} as status, count(score) as n, round(median(score), 6) as median, round(avg(score), 6) as mean from obs group by 1",
    "audit_top_values": f"""with {_OBS}, c as (select field, status, value, count(*) as n from ({_audit(['subclade', 'clade', 'legacy'])}) group by all)
        select *, cast(row_number() over (partition by field, status order by n desc, value) as integer) as rank from c qualify rank <= 20""",
    "audit_lineage_table": f"""with {_OBS}, c as (select legacy as lineage, count(*) as n, cast(count_if({_STATUS.format('subclade')} <> 'assigned') as bigint) as not_assigned from obs group by all)
        select *, round(not_assigned / n, 6) as rate from c order by n desc, lineage limit 20""",
    "audit_run_transitions": f"""with {_OBS}, r as (select legacy as folder, cast(year(collection_date) as integer) as run, obs_id % 997 as name, obs_id as line, {_STATUS.format('subclade')} as status from obs),
        l as (select folder, run, name, arg_max(status, line) as status from r group by all), f as (select distinct folder, run from l),
        p as (select a.folder, a.run as left_run, b.run as right_run from f a join f b on a.folder = b.folder and a.run < b.run),
        n as (select distinct p.*, name from p join l on l.folder = p.folder and l.run in (left_run, right_run)),
        j as (select n.folder, left_run, right_run, coalesce(x.status, 'absent') as left_status, coalesce(y.status, 'absent') as right_status from n
              left join l x on x.folder = n.folder and x.run = left_run and x.name = n.name left join l y on y.folder = n.folder and y.run = right_run and y.name = n.name)
        select *, count(*) as n from j group by all""",
    "error_categories": f"""with m as (select lower({_WORDS}[1 + o_orderkey % 8]) as m from orders)
        select case when m like '%unknown nucleotide%' then 'unknown_nucleotide' when m like '%extracted gene sequence is empty%' or m like '%unable to find start%' then 'gene_not_found_or_empty'
               when m like '%too short%' then 'sequence_or_gene_too_short' when m like '%translation%' then 'translation_error' when m like '%alignment%' then 'alignment_error' else 'other' end as category,
               count(*) as n from m where trim(m) <> '' group by all""",
    "repeated_keys": """with c as (select l_orderkey || '-' || l_linenumber as k, count(*) as c from lineitem group by all)
        select cast(sum(c) as bigint) as n_rows, cast(sum(c - 1) as bigint) as duplicate_rows, max(c) as largest from c""",
    "cutoff_table": f"""with {_SPANS}, {_COARSE} select spans.*, (select count(*) from coarse where d between recent_start and recent_end) as recent_instances,
        (select count(*) from coarse where d between annual_start and annual_end) as annual_instances from spans""",
    "window_aligned_counts": f"with {_COUNTS} select * from counts",
    "unique_accession_join": """with l as (select (o_orderkey + 600) % 14500 as k, o_orderkey as obs_id from orders), u as (select k, any_value(obs_id) as obs_id from l group by k having count(*) = 1),
        r as (select doc_id as k, any_value(quality) as quality from labels group by doc_id having count(*) = 1) select k, obs_id, quality from u join r using (k)""",
    "frozen_panel_inequality": f"""with {_SPANS}, {_COARSE}, r as (select branch, unnest([min(d), max(d)]) as reference_date from coarse group by branch)
        select window_id, forecast_cutoff, branch, reference_date from r join spans on reference_date < forecast_cutoff""",
    "past_strain_antijoin": f"""with {_SPANS}, r as (select cast(o_orderdate as date) as d, o_custkey as q from orders),
        p as (select window_id, q, count(*) as w, max(d) as seen from r join spans on d >= cast(recent_end - interval 5 year as date) and d < recent_start group by all),
        c as (select distinct window_id, q from r join spans on d between recent_start and recent_end)
        select window_id, count(*) as strains, cast(sum(w) as bigint) as weight, max(seen) as last_seen from p anti join c using (window_id, q) group by window_id""",
    "instance_expansion_unique_hit": f"""with {_SEQ}, t as (select record_index, header, 'doc' || record_index || regexp_replace(header, '^doc[0-9]+\\|(HA|NA)\\|', '|') as plain,
               'doc' || record_index * 2 || regexp_replace(header, '^doc[0-9]+\\|(HA|NA)\\|', '|') as asked, sequence from seqs),
        c as (select a.record_index as id, b.sequence from t a join t b on a.header = b.header union select a.record_index, b.sequence from t a join t b on a.asked = b.plain),
        s as (select distinct sequence from seqs where record_index % 3 <> 0),
        h as (select id, count(s.sequence) as hits from c left join s using (sequence) group by id)
        select case when hits = 1 then 'unique' when hits > 1 then 'ambiguous' when hits = 0 then 'unscored' else 'missing' end as status, count(*) as n, cast(count_if(hits = 1) as bigint) as resolved
        from t left join h on h.id = t.record_index group by 1""",
    **{f"forecast_{m.lower().replace('-', '_')}": f"with {_PAST}, {sql} select window_id, h, branch, round(value, 6) as value from {m.lower().replace('-', '_')}" for m, sql in _MODELS.items()},
    "forecast_changepoint": f"with {_PAST}, {_CPS} select window_id, h, branch, round(value, 6) as value from cps",
    "changepoint_diagnostics": f"""with {_PAST}, {_CPS} select window_id, any_value(split) as split, round(any_value(change_score), 6) as change_score, round(max(norm), 6) as slope_norm, max(bins) as regime_bins
        from capped join splits using (window_id) group by window_id""",
    "count_trend_features": f"""with {_PAST}, {_MODELS['C-B2']}, f as (
            select window_id, branch, cast(sum(case when t = 0 then n else 0 end) as bigint) as current_count, cast(sum(case when t < 13 then n else 0 end) as bigint) as recent_count,
                   cast(sum(case when t >= 13 then n else 0 end) as bigint) as previous_count, least(greatest(avg(case when t < 13 then case when n > 0 then 1.0 else 0.0 end end), 1e-6), 1 - 1e-6) as q
            from look group by all
        ), g as (
            select *, current_count / sum(current_count) over w as cs, recent_count / sum(recent_count) over w as rs, previous_count / sum(previous_count) over w as ps from f window w as (partition by window_id)
        )
        select g.window_id, g.branch, current_count, recent_count, previous_count, round(ln(cs + 1e-9), 6) as log_current_share, round(ln(1 + recent_count), 6) as log_recent_count,
               round(ln(recent_count + 0.5) - ln(previous_count + 0.5), 6) as log_count_growth, round(ln(rs + 1e-9) - ln(ps + 1e-9), 6) as log_share_growth,
               round(ln(q) - ln(1 - q), 6) as logit_presence, round(coalesce(growth, 0), 6) as composition_slope
        from g left join c_b2_g using (window_id, branch)""",
    "surrogate_scores": f"with {_FIXED} select record_index, piece, round(length(regexp_replace(sequence, '[^AVILMFWY]', '', 'g')) / length(sequence), 6) as score from fixed",
    "metrics_six_model": f"with {_EVAL} select {_DETAIL} from metrics",
    "top1_accuracy": f"with {_EVAL} select model, window_id, round(top1_accuracy, 6) as top1_accuracy from top1",
    "rolling_six_model_detail": f"with {_EVAL} select {_DETAIL}, round(top1_accuracy, 6) as top1_accuracy from detail",
    "rolling_six_model_summary": f"""with {_EVAL}, w as (select *, round(mean_tvd, 9) = min(round(mean_tvd, 9)) over (partition by window_id) as win from detail)
        select model, count(distinct window_id) as windows, round(avg(mae), 6) as mae, round(avg(rmse), 6) as rmse, round(avg(mean_tvd), 6) as mean_tvd, round(stddev_samp(mean_tvd), 6) as std_tvd,
               round(avg(mean_jsd), 6) as mean_jsd, round(avg(top1_accuracy), 6) as top1_accuracy, cast(count_if(win) as bigint) as window_wins from w group by model""",
    "window_wins": f"with {_EVAL} select window_id, model, round(mean_tvd, 6) as mean_tvd from detail qualify round(mean_tvd, 9) = min(round(mean_tvd, 9)) over (partition by window_id)",
    "score_ranking": "select o_orderpriority as branch, o_orderkey as obs_id, o_totalprice as score, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as integer) as rank from orders qualify rank <= 100",
    "score_completeness": f"with {_OBS} select count(*) as records, cast(count_if(obs_id % 4 <> 0) as bigint) as completed, count(distinct legacy) as sources, cast(0 as bigint) as invalid from obs",
    "score_summary_by_year_clade": f"""with {_OBS}, b as (select cast(year(collection_date) as integer) as y, coalesce({_FIELD.format('clade')}, 'unassigned') as c, score from obs)
        select y as year, c as clade, cast(grouping(y, c) as integer) as level, count(*) as n, round(avg(score), 4) as mean_score, round(min(score), 4) as min_score, round(max(score), 4) as max_score,
               min(y) as first_year, max(y) as last_year from b group by grouping sets ((y), (y, c), (c))""",
    "score_by_date_bin": f"""select {_BIN.format('cast(o_orderdate as date)')} as bin, count(*) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.1), 4) as q10,
        round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.9), 4) as q90 from orders group by 1""",
    "branch_signal_window": f"""with {_SIGNAL} select window_id, branch, previous_count, next_count, scored, round(mean_score, 4) as mean_score, round(median_score, 4) as median_score, round(max_score, 4) as max_score,
        round(previous_share, 4) as previous_share, round(next_share, 4) as next_share, round(share_change, 4) as share_change from changed""",
    "signal_correlations": f"""with {_SIGNAL}{_RANKED} select window_id, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, count(*) as pairs from ranked group by window_id""",
    "signal_leaders": f"""with {_SIGNAL}, a as (select window_id, first(branch order by round(next_share, 9) desc, branch) as high_next_share, first(branch order by round(previous_share, 9) desc, branch) as high_previous_share from changed group by window_id),
        b as (select window_id, first(branch order by round(mean_score, 9), branch) as low_mean_score, first(branch order by round(mean_score, 9) desc, branch) as high_mean_score from changed where mean_score is not null group by window_id)
        select * from a join b using (window_id)""",
    "branch_features": f"""with {_DIST}, r as (select window_id, branch, count(*) as scored_sequences, avg(distance) as mean_distance, avg(score) as mean_fitness from dist join spans on d between recent_start and recent_end group by all),
        y as (select window_id, avg(distance) as yd, avg(score) as yf from dist join spans on d between annual_start and annual_end group by all),
        c as (select window_id, branch, count(*) as n from dist join spans on d between recent_start and recent_end group by all),
        f as (select window_id, branch, count(*) as n from dist join spans on d between target_start and target_end group by all),
        cs as (select window_id, branch, n / sum(n) over (partition by window_id) as current_share from c), fs as (select window_id, branch, n / sum(n) over (partition by window_id) as next_share from f)
        select window_id, branch, scored_sequences, round(mean_distance, 4) as mean_distance, round(mean_fitness, 4) as mean_fitness, round(coalesce(current_share, 0), 4) as current_share, round(coalesce(next_share, 0), 4) as next_share,
               round(coalesce(next_share, 0) - coalesce(current_share, 0), 4) as share_change, round(mean_distance - yd, 4) as escape_excess, round(mean_fitness - yf, 4) as fitness_excess
        from r join y using (window_id) left join cs using (window_id, branch) left join fs using (window_id, branch) where scored_sequences >= 10""",
    "distance_signal": f"""with {_DIST}, r as (select window_id, branch, count(*) as scored, avg(distance) as m, median(distance) as md from dist join spans on d between recent_start and recent_end group by all),
        y as (select window_id, avg(distance) as a from dist join spans on d between annual_start and annual_end group by all), p as (select window_id, avg(distance) as b from dist join spans on d between previous_half_start and previous_half_end group by all),
        f as (select window_id, branch, count(*) as n from dist join spans on d between target_start and target_end group by all)
        select window_id, branch, scored, round(m, 4) as mean_distance, round(md, 4) as median_distance, round(m - a, 4) as excess, round(m - b, 4) as excess_previous, coalesce(n, 0) as next_count
        from r join y using (window_id) left join p using (window_id) left join f using (window_id, branch) where scored >= 10""",
    "pair_weighted_summary": """with e as (select vec_id, label, [x::double for x in embedding] as v from embeddings),
        r as (select vec_id, label, v, 1 + vec_id % 3 as w from e qualify row_number() over (partition by label order by vec_id) <= 64),
        p as (select e.vec_id as q, r.vec_id as ref, r.w, round(sqrt(list_sum([(e.v[i] - r.v[i]) * (e.v[i] - r.v[i]) for i in range(1, 65)])), 6) as x from e join r using (label)),
        c as (select *, sum(w) over (partition by q order by x, ref rows unbounded preceding) as cum, sum(w) over (partition by q) as total from p)
        select q as query_id, cast((2 * sum(w * cast(round(x * 1000000) as bigint)) + sum(w)) // (2 * sum(w)) as bigint) / 1000000.0 as mean, min(case when cum >= 0.5 * total - 1e-12 then x end) as p50,
               min(case when cum >= 0.1 * total - 1e-12 then x end) as p10, min(case when cum >= 0.9 * total - 1e-12 then x end) as p90, min(x) as least, max(x) as most, count(*) as panel_size from c group by q""",
    "score_resume_antijoin": "select doc_id, lang from documents anti join labels using (doc_id)",
}

"""Queries opN_<name>: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, minhash, neighbours, packing, partitions, prefixtrie, quality, substring, suffix, toxicity, vectorcodes, warc

#: Which public vocabulary the tokenising queries use; its place is asked for on every machine.
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int):
    """Which of ``folds`` parts a document belongs to."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(spark, _table(spark, sf_dir, "documents"), part=85, whole=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(fold(4) != 2))
    scored = toxicity.score(spark, docs, net)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.SCORE_THRESHOLD).cast("int").alias("predicted"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_rows(substring.remove_repeats(spark, _table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, _table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.groups(spark, _table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = langid.fit(docs.where(fold(5) != 0))
    found = langid.predict(spark, docs, models)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest_rows(suffix.remove_repeats(spark, _table(spark, sf_dir, "documents"), keep="none"), text=True)


def op11_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.search(spark, _table(spark, sf_dir, "embeddings"))


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_nodes(spark, _table(spark, sf_dir, "conversations"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(spark, _table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_substring": op3_substring,
    "op4_quality": op4_quality,
    "op5_neighbours": op5_neighbours,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_suffix": op10_suffix,
    "op11_partitions": op11_partitions,
    "op12_prefixtrie": op12_prefixtrie,
    "op13_vectorcodes": op13_vectorcodes,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality": r"""
        with d as (
            select row_number() over () as r, doc_id, coalesce(lang, 'und') as language, coalesce(text, '') as text from documents
        ), w as (
            select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from d
        ), windows as (
            select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8
        ), keyed as (
            select r, i, count(*) over (partition by r, array_to_string(words[i : i + 7], ' ')) as n from windows
        ), repeated as (
            select r, sum(least(coalesce(following - i, 8), 8)) as n_repeat_words
            from (select r, i, lead(i) over (partition by r order by i) as following from keyed where n > 1) group by r
        ), base as (
            select w.r, doc_id, language, cast(len(words) as bigint) as n_words, cast(length(text) as double) as chars,
                   cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
                   cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
                   cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
                   cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
                   length(text) - length(regexp_replace(text, '[a-z]+', '', 'g')) as k1,
                   length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as k2,
                   length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) as k3,
                   length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) as k4,
                   length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]+', '', 'g')) as k5,
                   words
            from w left join repeated using (r)
        ), shorts as (
            select r, language, lower(word) as word from (select r, language, unnest(words) as word from base) where length(word) <= 4
        ), totals as (
            select language, sum(n_words)::double as all_words, sum(chars) as c, sum(k1) / sum(chars) as q1, sum(k2) / sum(chars) as q2,
                   sum(k3) / sum(chars) as q3, sum(k4) / sum(chars) as q4, sum(k5) / sum(chars) as q5,
                   sum(chars - k1 - k2 - k3 - k4 - k5) / sum(chars) as q6
            from base group by language
        ), common as (
            select language, word, n from (
                select language, word, count(*) as n, row_number() over (partition by language order by count(*) desc, word) as place
                from shorts group by language, word
            ) where place <= 32
        ), class_terms as (
            select r, unnest([k1 / chars, k2 / chars, k3 / chars, k4 / chars, k5 / chars, (chars - k1 - k2 - k3 - k4 - k5) / chars]) as p,
                   unnest([q1, q2, q3, q4, q5, q6]) as q
            from base join totals using (language) where chars >= 200 and all_words >= 2000
        ), met as (
            select r, word, count(*) as n from shorts group by r, word
        ), pairs as (
            select base.r, base.language, common.n as ref, coalesce(met.n, 0) as own
            from base join common using (language) left join met on met.r = base.r and met.word = common.word
            where n_words >= 50
        ), word_terms as (
            select r, own / n_words as p, ref / all_words as q from pairs join base using (r) join totals on totals.language = pairs.language where all_words >= 2000
            union all
            select r, (any_value(n_words) - sum(own)) / any_value(n_words), (any_value(all_words) - sum(ref)) / any_value(all_words)
            from pairs join base using (r) join totals on totals.language = pairs.language where all_words >= 2000 group by r
        ), distances as (
            select r, any_value(kind) as kind, sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) as total
            from (select r, p, q, 'char' as kind from class_terms union all select r, p, q, 'word' from word_terms) group by r, kind
        ), judged as (
            select base.*, case when a.total is not null then round(sqrt(greatest(a.total / 2 / ln(2), 0)), 6) end as char_distance, case when b.total is not null then round(sqrt(greatest(b.total / 2 / ln(2), 0)), 6) end as word_distance,
                   n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, length(bin(n_words)) as bits
            from base left join distances a on a.r = base.r and a.kind = 'char' left join distances b on b.r = base.r and b.kind = 'word'
        ), limits as (
            select language, bits, case when count(char_distance) >= 50 then quantile_cont(char_distance, 0.5) + 6 * greatest(quantile_cont(char_distance, 0.75) - quantile_cont(char_distance, 0.25), 0.02) end as c,
                   case when count(word_distance) >= 50 then quantile_cont(word_distance, 0.5) + 6 * greatest(quantile_cont(word_distance, 0.75) - quantile_cont(word_distance, 0.25), 0.02) end as w
            from judged group by grouping sets ((language, bits), (language))
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and not coalesce(char_distance > coalesce(own.c, every.c) + 1e-9, false) and not coalesce(word_distance > coalesce(own.w, every.w) + 1e-9, false) as kept,
               char_distance, word_distance
        from judged left join limits own on own.language = judged.language and own.bits = judged.bits left join limits every on every.language = judged.language and every.bits is null
    """,
    "op9_warc": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages
        ), k as (
            select digest, n, max(page_id) as keeper from p where n >= 1000 group by digest, n
        )
        select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
               case when p.page_id < k.keeper then 'revisit' else 'response' end as record_type,
               case when p.page_id < k.keeper then k.keeper end as refers_to
        from p left join k on p.digest = k.digest and p.n = k.n
    """,
    "op12_prefixtrie": """
        with turns as (
            select conv_id, list(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as own,
                   list(strlen(coalesce(text, '')) order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as own_bytes
            from conversations where conv_id is not null group by conv_id
        ), heads as (
            select conv_id, own, own_bytes, conv_id - conv_id % 5 as first,
                   cast(xor(list_reduce(list_prepend(4294967295::ubigint, range(0, 8 * strlen(conv_id::varchar))::ubigint[]), lambda s, i:
                       case when (case when i % 8 = 0 then xor(s, ascii(substr(conv_id::varchar, (i // 8 + 1)::bigint, 1))::ubigint) else s end) % 2 = 1
                            then xor((case when i % 8 = 0 then xor(s, ascii(substr(conv_id::varchar, (i // 8 + 1)::bigint, 1))::ubigint) else s end) >> 1, 3988292384::ubigint)
                            else (case when i % 8 = 0 then xor(s, ascii(substr(conv_id::varchar, (i // 8 + 1)::bigint, 1))::ubigint) else s end) >> 1 end), 4294967295::ubigint) % 9 as bigint) as h
            from turns
        ), rebuilt as (
            select a.conv_id, list_concat(coalesce(b.own, [])[1 : h], a.own[h + 1 :]) as path, list_concat(coalesce(b.own_bytes, [])[1 : h], a.own_bytes[h + 1 :]) as bytes
            from heads a left join turns b on b.conv_id = a.first
        ), members as (
            select conv_id, d, path[1 : d] as node, case when d > 0 then path[1 : d - 1] end as above, case when d > 0 then bytes[d] else 0 end as own, d = len(path) as ends
            from (select *, unnest(range(0, len(path) + 1)) as d from rebuilt)
        ), nodes as (
            select node, any_value(above) as above, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(own) as saved,
                   sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
            from members group by node
        ), children as (
            select above as node, count(*) as n_children from nodes where above is not null group by above
        ), known as (
            select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)
        ), below as (
            select node[1 : d] as node, sum(saved) as saved_tokens, sum((n_children = 0)::int) as n_leaves
            from (select node, saved, n_children, unnest(range(0, depth + 1)) as d from known) group by node[1 : d]
        )
        select k.conv_id, k.depth, up.conv_id as parent_conv_id, k.n_convs, k.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, k.ends_sha256
        from known k join below using (node) left join nodes up on up.node = k.above
    """,
    "op13_vectorcodes": """
        with kept as materialized (
            select row_number() over (order by vec_id nulls last) - 1 as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
            from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), parts as materialized (
            select r, p, v[1 + p * len(v) // 16 : (p + 1) * len(v) // 16] as x from (select r, v, unnest(range(0, 16)) as p from kept)
        ), book0 as materialized (
            select p, r as i, x from parts where r < 64
        ), codes1 as materialized (
            select r, p, x, min(dist * 64 + i) as best
            from (select r, parts.p, parts.x, i, cast(list_sum(list_transform(range(1, len(parts.x) + 1), lambda j: (parts.x[j] - book0.x[j]) * (parts.x[j] - book0.x[j]))) as bigint) as dist
                  from parts join book0 on book0.p = parts.p) group by r, p, x
        ), book1 as materialized (
            select book0.p, book0.i, coalesce(f.x, book0.x) as x
            from book0 left join (
                select p, i, list((s - ((s % n) + n) % n) // n order by j) as x
                from (select p, best % 64 as i, j, cast(sum(x[j]) as bigint) as s, count(*) as n from (select *, unnest(range(1, len(x) + 1)) as j from codes1) group by p, best % 64, j)
                group by p, i) f on f.p = book0.p and f.i = book0.i
        ), codes2 as materialized (
            select r, p, x, min(dist * 64 + i) as best
            from (select r, parts.p, parts.x, i, cast(list_sum(list_transform(range(1, len(parts.x) + 1), lambda j: (parts.x[j] - book1.x[j]) * (parts.x[j] - book1.x[j]))) as bigint) as dist
                  from parts join book1 on book1.p = parts.p) group by r, p, x
        ), book2 as materialized (
            select book1.p, book1.i, coalesce(f.x, book1.x) as x
            from book1 left join (
                select p, i, list((s - ((s % n) + n) % n) // n order by j) as x
                from (select p, best % 64 as i, j, cast(sum(x[j]) as bigint) as s, count(*) as n from (select *, unnest(range(1, len(x) + 1)) as j from codes2) group by p, best % 64, j)
                group by p, i) f on f.p = book1.p and f.i = book1.i
        ), codes3 as materialized (
            select r, p, x, min(dist * 64 + i) as best
            from (select r, parts.p, parts.x, i, cast(list_sum(list_transform(range(1, len(parts.x) + 1), lambda j: (parts.x[j] - book2.x[j]) * (parts.x[j] - book2.x[j]))) as bigint) as dist
                  from parts join book2 on book2.p = parts.p) group by r, p, x
        ), coded as (
            select r, string_agg(printf('%02x', best % 64), '' order by p) as code, cast(sum(best // 64) as bigint) as error from codes3 group by r
        )
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(x[j]::varchar, ',' order by p, i, j)) from (select *, unnest(range(1, len(x) + 1)) as j from book2)) as codebooks_sha256
        from kept join coded using (r)
    """,
}

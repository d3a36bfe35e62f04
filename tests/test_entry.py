"""Registered queries and their SQL give the same rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from driftloom.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FEW = ["label_fallback_nextclade", "header_fields", "bin_share_dense", "consensus_by_position", "hash_shard_owner", "audit_run_transitions", "forecast_c_b2", "changepoint_diagnostics", "signal_correlations", "past_strain_antijoin", "pair_weighted_summary",
       "score_store_upsert", "striped_pending", "pair_panel_summary", "fasta_numbers", "fasta_positional_zip", "audit_counters", "strain_labels", "late_event_bins", "checked_query_keys", "references_before_cutoffs"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", FEW)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(map(plain, r)) for r in con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())
    assert ours == theirs


def test_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

"""Registered queries against their oracles in DuckDB, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = "a1_read_telemetry a4_variant_fields a8_capture_scan s5_ring_files b20_percent_of t1_station_holdout t6_capped_windows l6_versioned_policies l7_session_table s10_stream_sessions l3_stream_rules a12_constants b4_msg_parts b5_phase_of b6_severities b7_markers s1_sessionize s2_reopen s3_carry_quiet s5_dedupe_files s6_data_cuts f1_phase f3_latency f4_ewm f5_retx f10_deviations f12_battery c1_dialogs c2_message_timeouts c5_ongoing c9_illegal_successor m2_match_pending g1_markers g4_cable_stuck g8_rematch g12_no_power k1_content_dedupe k6_training_snapshot t5_windows t7_state_stack l2_session_windows l5_station_counts".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    names = [c[0] for c in relation.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[i] for i in order]) for r in relation.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

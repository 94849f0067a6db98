"""A query of every family against its SQL; tools/check.py compares all of them."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as spark_entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a2_all_kpis", "a13_compare_groups", "a26_duration_histogram", "f7_filter_spec", "f13_segments", "j4_index_missing_ids",
    "k2_upsert", "k7_summary", "l6_label_calls", "l7_interpret", "l9_answer_questions", "o2_deep_page_rows", "p6_record_rules",
    "r1_stream_import", "r3_window_kpis", "s1_csv_import", "t2_keywords", "t10_pair_similarity", "v7_hybrid_search",
    "v9_retrieve", "w5_retention_first_monthly", "w9_volume_daily_by_agent",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    status, _, _, note = check.compare(spark, con, SF, name, spark_entry.queries()[name], spark_entry.oracle_sql()[name])
    assert status == "ok", note


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 20


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())

"""Registered queries: each has SQL, and a sample agrees on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"


def test_every_query_is_stated_in_sql():
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(entry.oracle_sql()) - set(entry.LLM_ORACLE)


@pytest.mark.parametrize(
    "name",
    [
        "agg7_agg8_agg9_agg10_engagement_summary", "win3_win4_srt2_ranked_records", "flt5_win9_join7_exclusion_outcomes",
        "agg1_sentiment_summary", "agg6_keyword_totals", "agg14_trend_summary", "scl9_scl10_srt3_scl20_alerts", "snk4_first_writers",
        "str5_sealed_days",
    ],
)
def test_sample_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert compare(spark, con, name, FOLDER).startswith("SAME")

"""Queries run on the smallest tables and agree with their SQL."""

import datetime
import math

import duckdb
import pytest

from millrace import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Queries of each kind; the driver compares them all.
SOME = (
    "s5_normalize_nulls", "t2_parse_rates", "f4_top_k", "d8_row_classes", "p1_email", "r1_hmac", "x4_text_stats", "n11_policy", "e3_weekly_report", "a5_suite_figures", "m4_weights",
    "s1_read_delimited", "s2_read_json_records", "s3_read_jsonl", "s6_read_lines", "s8_write_table", "s8_write_report", "p3_ssn", "p7_entropy", "x6_lexicon", "a8_config_diff",
    "a9_validate_configs", "a10_parse_tools", "a11_tool_risk", "r4_card", "m1_learn_spec", "m2_sensitive_kinds", "m9_generate", "m11_categories", "m12_numbers", "m13_moments", "m14_personal", "n1_canonical_hosts", "n16_ledger", "a12_denied_tools",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_and_sql_agree(spark, name):
    found = registry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert [r.replace(".0,", ",").replace(".0]", "]") for r in rows] == [r.replace(".0,", ",").replace(".0]", "]") for r in want]

"""Registered queries against their DuckDB text on the smallest tables.

A representative set by default; all of them with VOLTLOOM_ALL=1.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("VOLTLOOM_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SOME = ("a01_blocks_on_grid", "a01_incremental_blocks", "g03_short_gap_fill", "g05_meter_off", "u01_long_table",
        "a07_sensitivity_curve", "a41_headline", "m13_decompose_low_occupancy", "h01_h02_compare_groups",
        "n01_n02_scored_rows", "n08_pooled_answer", "g07_episodes", "m06_feature_selection", "v03_standardised_days",
        "n03_placed_events", "n09_one_sided_episodes", "s01_s03_meter_files", "s04_occupancy_files", "h04_sampling_distribution",
        "j09_overlapping_bands", "j09_long_events", "a37_plot_sample", "a37_keyed_sample", "a01_compacted_blocks")
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("VOLTLOOM_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    return str(v) if isinstance(v, str) else repr(float(v))


def rows(pdf):
    return sorted(tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    d = entry.entry(spark)
    assert d.columns and d.count() == 4


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())

"""Registered queries against their SQL twins, and the shape of chosen plans, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from studyloom.session import TABLES, Tables

SF = "/root/testdata/sf0.001"
KEYS = ["flagship_enrollment_report", "s02_side_by_side_blocks", "s14_period_scan", "s17_compact_export", "x07_choice_list", "x09_date_parse", "x31_secret_redaction", "f04_eligibility",
        "j03_nearest_join", "j12_nearest_gap", "a06_participant_audit", "a22_cross_project_comparison", "a31_monthly_resample", "a46_agreement", "a49_inequality", "a60_trust_rules",
        "w01_ranked_candidates", "w04_interval_merge", "w10_rolling_backtest", "o01_priority_queue", "h07_weight_sensitivity", "t2_windowed_volume"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_twin(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    cur = duck.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), cols)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_row_of_the_catalogue_is_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 240


def test_no_cartesian_products(spark):
    for key in ("j09_interval_overlap", "j10_candidate_pool", "j14_milestone_counts", "j21_name_resolution", "a22_cross_project_comparison", "a53_member_loads", "x42_load_band", "h05_selection_stability"):
        text = plan(entry.queries()[key](spark, SF))
        assert "CartesianProduct" not in text, key


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["s14_period_scan"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    text = plan(entry.queries()["x41_minimal_projection"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert plan(entry.queries()["o02_top_k_per_group"](spark, SF)).count("WindowGroupLimit") == 2


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 12 and "shown" in df.columns


def test_tables_reject_unknown_names(spark):
    with pytest.raises(AttributeError):
        Tables(spark, SF).nope

"""Registered queries against their SQL twins on the small tables (ALL_QUERIES=1 runs every one)."""

import os

import pytest

from oracle_check import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = """financial_panel outcome_metrics succession_score survival_score_blocks period_continuity market_share_rules imputation_quality structural_fill robust_scale
outliers_treated market_ranks kendall_tau ols_standard_errors kruskal_by_market trend_pack cycle_pack seasonal_decomposition kaplan_meier_by_market logrank_pairs
concordance_index did_staggered two_stage_least_squares nearest_match kernel_match market_dynamics competitive_strength transition_matrix decline_periods
integration_scores cluster_quality parent_components event_sessions factors_succession""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_catalogue_is_consistent():
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q) and len(q) > 250 and set(SAMPLE) <= set(s)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) in ("", "no rows")
    else:
        df.count()

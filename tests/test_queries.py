"""Registered queries against their SQL, and the contract of the entry module.

The whole set: ``python tests/oracle_check.py /root/testdata/sf0.01``.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.01"
CHECKED = (
    "f1_state_features", "f4_rolling_scaler", "o1_forward_outcomes", "o2_first_touch", "j1_resample", "v5_integrity", "v14_series_audit", "j12_interval_coverage", "j8_nearest_neighbours",
    "t5_target_records", "t3_two_sided_direction", "w1_max_drawdown", "w8_regime_transitions", "w9_lagged_correlation", "a5_extended_statistics", "a8_context_atlas", "a10_hierarchical_contexts",
    "j18_candidate_matching", "b2_block_bootstrap", "b6_hac_pvalue", "b8_holm", "q9_fresh_discovery", "q10_fresh_confirmation", "q23_campaign_verdict", "q25_chain_verification",
    "r4_streamed_candles", "r5_session_chain", "r6_daily_loss_latch", "r8_streamed_lifecycle",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, name, FOLDER)
    assert line.startswith("ok") and "EMPTY" not in line, line


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 170

"""A quick slice of the oracle comparison; ``python tests/oracle_compare.py SF_DIR`` runs all."""

import os

import pytest

import __spark_entry__ as driver
from oracle_compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "S3_daily_bars", "M3_snapshot_intervals", "M6_membership_flag", "C2_calendar_positions",
    "U4_cross_section_rank", "F12_sortino_like", "T6_cci", "T7_adx", "T13_supertrend",
    "D1_calendar_features", "Y2_future_volatility", "Q11_sample_metadata", "Q16_sample_tensors",
    "Q19_rank_batches", "E4_metric_summary",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, driver.queries()[name], driver.oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 5334
    assert set(driver.oracle_sql()) <= set(driver.queries())

"""Queries against DuckDB on the small tables; FAIRTAG_ALL_CHECKS=1 runs every one of them."""

import os
from pathlib import Path

import pytest

import checks
from checks.compare_engines import compare, duck

SF = "/root/testdata/sf0.001"
checks.load_all()
SOME = ["dea_9_top_deals", "sta_8_mid_rank", "cls_classify", "ing_3_price_change_log", "cmp_6_ranking", "alr_3_cycle_alerts", "ret_4_current_retail"]
NAMES = sorted(checks.QUERIES) if os.environ.get("FAIRTAG_ALL_CHECKS") else SOME
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_sql():
    assert sorted(checks.ORACLES) == sorted(checks.QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())

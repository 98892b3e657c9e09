"""How often a query derives events from the tables, which is most of its work at size."""

import os

import pytest

from talliard.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def lineitem_reads(df) -> int:
    return optimized(df).count("Relation [l_orderkey#")


def test_routing_judges_rows_once(spark):
    found = registry.QUERIES["fi_06_routing"](spark, DIR)
    assert lineitem_reads(found) == 1 and "isnull(CASE" not in optimized(found)


@pytest.mark.parametrize("name", ["cx_05_history_moves", "cx_07_machine_with_history"])
def test_history_reads_what_machines_did_from_one_stage(spark, name):
    assert lineitem_reads(registry.QUERIES[name](spark, DIR)) == 0


def test_accounts_of_all_usage_are_found_once(spark):
    assert lineitem_reads(registry.QUERIES["cx_15_projects"](spark, DIR)) == 1


def test_accounts_of_logs_read_the_logs_once(spark):
    assert "] text" not in optimized(registry.QUERIES["pr_23_accounts_of_logs"](spark, DIR))

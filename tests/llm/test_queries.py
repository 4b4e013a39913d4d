"""The registered queries against their SQL, and the driver's entries."""

import oracle
import pytest

from cartwright.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", SQL)
def test_result_equals_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_the_driver_lists_them_and_the_pipeline():
    import __spark_entry__ as driver

    assert {*QUERIES, "pipeline"} <= set(driver.queries())
    assert set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op5_")])
def test_native_queries_run_no_python(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))

"""Every registered analysis against its DuckDB oracle on the driver's tables."""

import pytest

import __spark_entry__ as E
from retainr.checks.compare import compare, duckdb_connect
from retainr.checks.oracle_queries import SQL
from retainr.plans.registry import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL

# One-hot columns exist only for category values present in the data; the oracle lists the
# values present at sf0.01 (the scale of the driver's correctness run).
SF_FOR = {"modeling_dataset": SF_ORACLE}


@pytest.fixture(scope="module")
def cons():
    return {d: duckdb_connect(d) for d in {SF_SMALL, SF_ORACLE}}


def test_every_analysis_is_registered_with_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, cons, name):
    sf = SF_FOR.get(name, SF_SMALL)
    got = E.queries()[name](spark, sf).toPandas()
    want = cons[sf].sql(SQL[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort_month", "users_base", "repeat_users_30d",
                          "repeat_order_rate_30d_pct"]
    assert df.count() > 0

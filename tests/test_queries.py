"""Every registered query on the given tables, against its SQL."""

import pytest
from compare import connect, differences
from helpers import SF_DIR

import __spark_entry__ as entry
from fleetledger.checks.oracle import ORACLE
from fleetledger.checks.registry import QUERIES

ROWS_ONLY = {"probit_fit", "cost_model_coefficients"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ROWS_ONLY:
        assert result.collect()
    else:
        assert differences(result, duck, ORACLE[name]) == []


def test_every_query_but_the_iterative_fits_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["filter", "value", "timestamp", "operationalization", "category", "kpi"]
    assert found.count() == 3 * 2 * 5 * 24

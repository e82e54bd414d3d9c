"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.oracle_check import compare, connect
from voc_spark.plans.catalog import QUERIES
from voc_spark.plans.oracles import all_oracles

FOLDER = "/root/testdata/sf0.001"
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None

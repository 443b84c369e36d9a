import os

import pytest

import __spark_entry__ as entry
from nearkin.plans.oracles import ORACLES
from nearkin.plans.queries import QUERIES
from tests import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.queries().keys() >= entry.oracle_sql().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, SF_DIR)
    assert {c: _TYPES[t] for c, t in df.dtypes} == compare.sql_types(con, sql)
    assert compare.spark_rows(df) == compare.sql_rows(con, sql)

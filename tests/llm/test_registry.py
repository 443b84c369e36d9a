import pytest

from nearkin.llm.registry import ORACLES, QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = compare.connect(SF)
    assert compare.spark_rows(df) == compare.sql_rows(con, ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

import pytest
from oracle import assert_same

from tidemark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE[name], SF)

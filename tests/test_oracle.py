"""Every core query with SQL gives the rows of its SQL."""

import pytest
from compare import DATA, oracle, spark_rows

from codelode.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got = spark_rows(registry.queries()[name](spark, DATA))
    want = oracle(SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())

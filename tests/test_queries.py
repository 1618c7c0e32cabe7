import pytest

from tests.compare import connect, same
from tilmoch.plans import queries as Q

SQL = Q.oracle_sql()
SLOW = {"spn20_join9_admitted", "spn19_join8_projection", "spn14_invariants", "spn15_spn18_golden"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(Q.queries()[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["lang", "n_tokens", "n_boundary", "n_types"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

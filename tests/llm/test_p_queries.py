import pytest

from tests.compare import connect, same
from tilmoch.llm import queries as Q

FOUND = {"p2_found": ["tbl", "first_key", "copy_key"], "p3_found": ["corpus", "row_key", "item_id"], "p4_found": ["field", "row_key"], "p5_found": ["id_a", "id_b"], "p6_found": ["id_a", "id_b"], "p9_found": ["doc_id"]}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    assert df.count() > 0
    if name in FOUND:
        assert df.columns == FOUND[name] and df.distinct().count() == df.count()


@pytest.mark.parametrize("name", sorted(set(FOUND) & set(Q.oracle_sql())))
def test_columns(spark, sf, name):
    assert Q.queries()[name](spark, sf).columns == FOUND[name]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    same(Q.queries()[name](spark, sf), con, Q.oracle_sql()[name])


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in Q.queries()} == {f"p{i}" for i in range(1, 10)}

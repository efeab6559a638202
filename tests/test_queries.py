import pytest

from readloom.plans import catalogue

from tables import write_empty


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_empty(spark, str(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_empty_tables_with_clashing_columns(spark, empty, name):
    rows = catalogue.QUERIES[name](spark, empty).collect()
    assert len(rows) == {"minimizer_index_stats": 1, "graph_invariants": 7, "read_graph_invariants": 7, "rewritten_invariants": 7, "simplified_invariants": 7}.get(name, 0)


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)

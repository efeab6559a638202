import sys
from pathlib import Path

import pytest

from readloom.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tables import write_empty  # noqa: E402


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_empty(spark, str(tmp_path_factory.mktemp("empty")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_with_clashing_columns(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

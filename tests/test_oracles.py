"""Every query that SQL can express against DuckDB."""

import pytest

from loomline.plans import q_levels, q_rules, q_sampling, q_store, q_text  # noqa: F401
from loomline.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, con, name):
    same(QUERIES[name](spark, data), ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4

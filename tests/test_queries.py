"""Every reference query against its SQL oracle on the smallest tables; without an oracle, that it runs."""

import pytest

from compare import oracle, rows_of, rows_of_sql
from qbank.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, rows = rows_of(QUERIES[name](spark, SF))
    assert columns
    if name in ORACLE:
        assert (columns, rows) == rows_of_sql(duck, ORACLE[name])


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

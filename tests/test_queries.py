"""Every query with an SQL twin gives the twin's rows; the others give rows with a stable schema."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, con, name):
    assert compare(spark, con, QUERIES[name], TWINS[name], SF) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "item_id", "prediction", "rank"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)

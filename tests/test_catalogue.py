"""Every query against its SQL on the smallest tables; those without SQL must run."""

import pytest
from oracle import connect, difference

from lodestone import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert difference(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        df = QUERIES[name](spark, SF)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import pytest

from chronostrata.plans import catalogue
from oracle import rows_of_spark, rows_of_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows_of_spark(catalogue.QUERIES[name](spark, SMALL)) == rows_of_sql(catalogue.ORACLES[name], SMALL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

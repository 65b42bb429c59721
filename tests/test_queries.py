import pytest

import __spark_entry__ as entry
from critiq.plans.oracles import ORACLES
from critiq.plans.queries import QUERIES
from oracle import difference

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


def test_flagship_query(spark):
    row = entry.entry(spark).head()
    assert row.limit == 5 and row.evaluated_case_count > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) is None

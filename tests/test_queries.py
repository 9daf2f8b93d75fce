import pytest

import __spark_entry__ as entry
from oracle import SMALL, assert_same
from sheaf.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_gives_what_sql_gives(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["chunk_id", "content", "final_score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

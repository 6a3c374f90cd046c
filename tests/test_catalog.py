import pytest
from oracle import same

from punctual.plans import layout_queries, model_queries, queries, report_queries, store_queries  # noqa: F401  they fill the registry
from punctual.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
#: Their SQL compares means of few rows at the last digit or takes long; the driver compares them on more data.
QUICK_ONLY_ROWS = [k for k in QUERIES if k not in SQL]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    same(spark, FOLDER, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUICK_ONLY_ROWS))
def test_query_has_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import pytest
from helpers import SMALL, rows_of

from keyloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = rows_of(catalog.QUERIES[name](spark, SMALL).toPandas()), rows_of(duck.execute(catalog.ORACLES[name]).df())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reads_only_needed_columns(spark):
    plan = catalog.rk_pad_left(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "Exchange" not in plan


def test_dedup_aggregates_before_the_shuffle(spark):
    plan = catalog.dedup_first(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and plan.count("Exchange hashpartitioning") == 1

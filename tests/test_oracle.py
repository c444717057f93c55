"""Every registered query with an oracle agrees with DuckDB on the sf0.001 tables.

The tree queries train 100 trees or rounds; ``test_training.py`` covers their operators on a
small table, so they are left to ``tools/oracle_check.py``.
"""

import pytest

import __spark_entry__ as E
from tools.oracle_check import rows_of

QUERIES = E.queries()
SQL = E.oracle_sql()
LONG = {"random_forest", "boosted_trees", "train_all", "top_features"}
FAST = sorted(set(SQL) - LONG)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    dd = duck.execute(SQL[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert rows_of(sp) == rows_of(dd)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"route", "kind", "rank", "month", "mean_price"} <= set(df.columns)


def test_every_query_has_a_callable():
    assert len(QUERIES) >= 100 and all(callable(f) for f in QUERIES.values())

"""Every registered query against its SQL on the smallest tables, and the entry module."""

import pytest
from conftest import rows

from latticeworks.plans import registry

NO_SQL = {"rvm_fit", "rvm_fit_v1", "rvm_fit_sequential", "eam_hyper_update", "comparison_fits"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    assert got.num_rows
    if name in NO_SQL:
        assert name not in registry.ORACLE_SQL
        return
    want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count()

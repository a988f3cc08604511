"""Every core query against its SQL twin; those without one have to run and keep their schema."""

import pytest
from oracle import DATA, same

from driftnote.plans import registry

QUERIES = {n: q for m in registry.modules() for n, q in m.QUERIES.items()}
ORACLE = {n: s for m in registry.modules() for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

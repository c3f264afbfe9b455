"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import oracle
from maskbench.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


# violation reports may be empty at the smallest scale
MAY_BE_EMPTY = {"noop_arms", "duplicate_conflicts", "collapse_cross_check", "universe_difference",
                "arm_universe", "stream_ingest_conflicts", "round_trip_check", "table_disagreement"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name]).df()
        assert oracle.differences(got, want) == []
    else:
        assert len(got) or name in MAY_BE_EMPTY


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns[:2] == ["degradation", "level"] and df.count() > 0

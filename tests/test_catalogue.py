"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from tests.compare import canonical, tables

SF = "/root/testdata/sf0.001"


def _catalogue():
    from tickloom.plans import catalogue, cutoff_queries, extra_queries, more_queries, report_queries, stage_queries, stream_queries, table_queries, training_queries, window_queries  # noqa: F401

    return catalogue


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(_catalogue().QUERIES))
def test_query(spark, con, name):
    c = _catalogue()
    out = c.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in out.collect()]
    if name not in c.ORACLE:
        assert rows
        return
    rel = con.sql(c.ORACLE[name])
    assert sorted(rel.columns) == sorted(out.columns)
    assert canonical(out.columns, rows) == canonical(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

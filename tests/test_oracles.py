"""Every query of the engine against its SQL."""

import pytest

from joinloom import registry


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def oracle_of(duck, sql):
    found = duck.execute(sql)
    have = [c[0] for c in found.description]
    names = sorted(have)
    return names, sorted(repr(tuple(r[have.index(n)] for n in names)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, data, name):
    assert rows_of(registry.QUERIES[name](spark, data)) == oracle_of(duck, registry.ORACLES[name])


def test_entry():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0

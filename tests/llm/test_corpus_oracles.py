"""The corpus queries that SQL can express, against their SQL."""

import pytest

from joinloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    want = sorted(repr(tuple(r[have.index(n)] for n in names)) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want

"""Every registered query of the engine against its DuckDB SQL over whole tables."""

import pytest

from palimpsest.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf, duck, name):
    df = q.queries()[name](spark, sf)
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    res = duck.execute(sql)
    cols = [c[0] for c in res.description]
    want = sorted(map(tuple, res.fetchall()), key=str)
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == want

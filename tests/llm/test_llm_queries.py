"""Registered queries of the subpackage against SQL on the smallest tables."""

from pathlib import Path

import pytest

from siltstone.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(str([r[i] for i in at]) for r in found.fetchall())

"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from siltstone.plans import registry

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

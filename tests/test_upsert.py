"""The change feed: order, repetition, commits, skew, edge rows."""

import random

from siltstone.operators import upsert
from siltstone.sources.shared import PublishedTable

SCHEMA = "key binary, lsn bigint, op tinyint, value binary, txn_id bigint, bucket string"


def model(rows, done):
    best = {}
    for key, lsn, op, value, txn, _ in rows:
        if key is None or lsn is None or op not in (1, 2) or (txn is not None and txn not in done):
            continue
        rank = (lsn, op, value is not None, value or b"")
        best[key] = max(best.get(key, rank), rank)
    return best


def test_against_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "LOCAL_KEYS", 20)
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        key = rng.choice([None, b"", b"hot", b"hot", b"hot", b"h\x00t", b"k%d" % rng.randrange(300), b"x" * 50_000 if rng.random() < 0.01 else b"q"])
        op = rng.choice([1, 1, 2, 3, None])
        rows.append((key, rng.choice([None, *range(60)]), op, None if op == 2 else rng.choice([None, b"", b"a", b"b"]), rng.choice([None, 1, 2, 3]), "clash"))
    rows += rows[:500]
    changes = spark.createDataFrame(rows, SCHEMA).repartition(7)
    commits = spark.createDataFrame([(1,), (3,), (3,), (None,), (99,)], "txn_id bigint")
    state = upsert.apply_changes(changes, commits, buckets=5)
    got = {bytes(r["key"]): (r["lsn"], r["op"], r["value"]) for r in state.collect()}
    want = {k: (r[0], r[1], bytearray(r[3]) if r[2] else None) for k, r in model(rows, {1, 3}).items()}
    assert got == want and state.count() == len(want)
    table = PublishedTable(spark, str(tmp_path / "t"))
    live = upsert.live_rows(upsert.publish_state(state, table))
    assert {bytes(r["key"]) for r in live.collect()} == {k for k, r in want.items() if r[1] == 1}


def test_order_of_arrival_makes_no_difference(spark):
    rows = [(b"k", n, 1 + n % 2, b"v%d" % n if n % 2 == 0 else None, None, "") for n in range(50)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert [(r["lsn"], r["op"]) for r in upsert.apply_changes(df, buckets=2).collect()] == [(49, 2)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert upsert.apply_changes(none, spark.createDataFrame([], "txn_id bigint")).count() == 0


def test_publication_is_whole(spark, tmp_path):
    import pytest

    from siltstone.errors import StorageError

    table = PublishedTable(spark, str(tmp_path / "t"))
    with pytest.raises(StorageError):
        table.read()
    table.publish(spark.range(3))
    first = table.current()["generation"]
    old = table.read()
    table.publish(spark.range(5), expected=first)
    assert table.read().count() == 5 and old.count() == 3
    with pytest.raises(StorageError):
        table.publish(spark.range(1), expected=first)


def test_a_feed_in_parts_gives_the_whole_state(spark, tmp_path):
    rng = random.Random(9)
    rows = [(b"k%d" % rng.randrange(40), rng.randrange(200), rng.choice([1, 1, 2]), b"v%d" % rng.randrange(5), None, "") for _ in range(900)]
    rows = [(k, n, op, None if op == 2 else v, t, c) for k, n, op, v, t, c in rows]
    table = PublishedTable(spark, str(tmp_path / "t"))
    table.publish(upsert.apply_changes(spark.createDataFrame(rows[:1], SCHEMA), buckets=3))
    for a, b in ((1, 300), (300, 301), (200, 900)):  # a part comes twice
        part = spark.createDataFrame(rows[a:b], SCHEMA)
        table.publish(upsert.apply_changes(part, onto=table.read()), expected=table.current()["generation"])
    got = {bytes(r["key"]): (r["lsn"], r["op"]) for r in table.read().collect()}
    assert got == {k: r[:2] for k, r in model(rows, set()).items()}


def test_large_values_spill(spark, monkeypatch):
    """240 MB of values of one bucket by a database of 160 MB."""
    monkeypatch.setattr(upsert, "MEMORY", "160MB")
    rows = spark.range(9000).selectExpr(
        "cast(cast(id % 6000 as string) as binary) as key", "id as lsn", "1 as op",
        "cast(repeat(cast(id % 10 as string), 40000) as binary) as value",
    )
    got = upsert.apply_changes(rows, buckets=1)
    assert got.where("length(value) = 40000 and lsn >= 3000").count() == 6000


def test_buckets_by_rows_and_bytes():
    assert upsert.bucket_count(0) == 8 and upsert.bucket_count(10**8) == 200
    assert upsert.bucket_count(1000, 100 << 30) == 400

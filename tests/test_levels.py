"""Compaction of levels that hold far more than they may."""

import pytest

from siltstone.config import Settings
from siltstone.operators.changelog import Bound
from siltstone.sources.store import Delete, Put, Store

#: Many small files, and levels that are over their bounds at once.
TINY = Settings(target_sstable_bytes=4 << 10, level_base_bytes=16 << 10, memtable_size_threshold=1 << 30)


def value(i: int) -> bytes:
    return b"%06d" % i * 20


def filled(spark, tmp_path, n: int, op: int = 1) -> Store:
    """A store with ``n`` keys in small files of level 1."""
    store = Store.open(spark, str(tmp_path / "s"), TINY)
    rows = [(b"k%06d" % i, i + 1, op, value(i)) for i in range(n)]
    store.apply_versions(spark.createDataFrame(rows, "key binary, lsn long, op int, value binary"))
    store.flush()
    store.compact_level(0)
    return store


def kept(store: Store) -> dict:
    again = Store.open(store.spark, store.root, TINY)
    again.verify()
    return {bytes(r["key"]): bytes(r["value"]) for r in again.scan().collect()}


def test_a_level_over_its_bound_takes_one_merge(spark, tmp_path):
    store = filled(spark, tmp_path, 600)
    assert len(store.level(1)) > 20
    store.compact()
    rows = [(b"k%06d" % i, 10_000 + i, 1, b"new" * 40) for i in range(600)]
    store.apply_versions(spark.createDataFrame(rows, "key binary, lsn long, op int, value binary"))
    store.flush()
    store.compact_level(0)
    assert len(store.level(1)) > 20 and store.level(2)
    steps = store.manifest["version"]
    store.compact()
    assert store.manifest["version"] - steps <= 4  # a file at a time: more than 15
    assert sum(f["bytes"] for f in store.level(1)) <= TINY.level_base_bytes
    assert kept(store) == {k: b"new" * 40 for k, *_ in rows}


def test_files_that_meet_none_are_handed_down_unwritten(spark, tmp_path):
    store = filled(spark, tmp_path, 300)
    before = {f["path"]: f for f in store.files}
    assert all(f["level"] == 1 and f["deletes"] == 0 for f in before.values())
    store.compact()
    assert {f["path"] for f in store.files} == set(before)
    assert sum(f["bytes"] for f in store.level(1)) <= TINY.level_base_bytes and len(store.level(2)) > 5
    # the oldest went first, and none is dropped by the steps that follow
    assert max(f["file_id"] for f in store.level(2)) < min(f["file_id"] for f in store.level(1))
    for i in range(6):
        store.put(b"other%d" % i, b"x")
    assert kept(store) == {b"k%06d" % i: value(i) for i in range(300)} | {b"other%d" % i: b"x" for i in range(6)}


def test_files_with_deletes_are_merged_not_handed_down(spark, tmp_path):
    store = filled(spark, tmp_path, 250)
    store.compact()
    deep = store.level(2)
    lo, hi = min(f["smallest_key"] for f in deep), max(f["largest_key"] for f in deep)
    store.write_batch([Delete(b"k000003"), Put(b"z", b"last")])
    store.flush()
    store.compact_level(0)
    held = [f for f in store.files if f["deletes"]]
    assert all(f["smallest_key"] <= hi and f["largest_key"] >= lo for f in held)
    while store.level(1):
        store.compact_level(1)
    assert not [f for f in store.files if f["deletes"]]
    want = {b"k%06d" % i: value(i) for i in range(250) if i != 3} | {b"z": b"last"}
    assert kept(store) == want


def test_entries_without_a_count_of_deletes_still_stand(spark, tmp_path):
    store = filled(spark, tmp_path, 50)
    for f in store.files:
        del f["deletes"]
    store.verify()
    assert not store._hand_down(1, {f["file_id"] for f in store.files})
    store.files[0]["bytes"] += 1
    with pytest.raises(Exception, match="bytes is"):
        store.verify()


def test_deletes_of_a_prefix_over_a_full_level(spark, tmp_path):
    """A range read after a table of deletes was written onto a level far over its bound."""
    store = filled(spark, tmp_path, 800)
    gone = spark.createDataFrame([(2, b"k%06d" % i, None) for i in range(200, 300)], "op int, key binary, value binary")
    steps = store.manifest["version"]
    store.write_at_once(gone)
    assert store.maintenance_error is None and store.manifest["version"] - steps <= 4  # a file at a time: more than 30
    store.flush()
    store.compact_level(0)
    again = Store.open(spark, store.root, TINY)
    again.verify()
    found = again.scan(Bound(b"k000150", False), Bound(b"k000350"))
    assert [bytes(r["key"]) for r in found.collect()] == [b"k%06d" % i for i in range(151, 351) if not 200 <= i < 300]

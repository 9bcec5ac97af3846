"""Keys seen before, against a plain set."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import seen_keys
from siltstone.llm.seen_keys import PerfectHash, _distinct


def brute(records, files):
    seen, out = set(files) - {None}, set()
    for record_id, key in sorted((r for r in records if r[0] is not None and r[1] is not None)):
        if key in seen:
            out.add(record_id)
        seen.add(key)
    return out


def run(spark, records, files, **kw):
    r = spark.createDataFrame([(i, k, "x") for i, k in records], "record_id bigint, key binary, batch string")
    f = spark.createDataFrame([(k, 1, "y") for k in files], "key binary, file_id int, bucket string")
    return {x["record_id"] for x in seen_keys.seen_before(r, f, **kw).collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)
    mph = PerfectHash(h1, h2)
    assert sorted(mph.slots(h1, h2)) == list(range(n))
    if n >= 1000:
        assert mph.nbytes() * 8 / n < 8
        assert set(mph.slots(h2, h1)) <= {-1, *range(n)}


def test_distinct_keeps_the_first():
    h1 = np.array([5, 3, 5, 3], np.uint64)
    h2 = np.array([1, 1, 1, 2], np.uint64)
    assert sorted(_distinct(np.arange(4), h1, h2)) == [0, 1, 3]


@pytest.mark.parametrize("batch_rows", [7, 64, 1 << 20])
@pytest.mark.parametrize("bits", [2, 16])
def test_against_set(spark, batch_rows, bits):
    """Two-bit fingerprints make many wrong claims; the answer stays the same."""
    rng = random.Random(batch_rows + bits)
    keys = [b"", b"\x00", b"\x00\x00", b"hot", b"ho\x00t", *(b"k%d" % i for i in range(150)), b"long" * 20_000]
    records = [(i, rng.choice([None, b"hot", b"hot", *keys])) for i in rng.sample(range(3000), 500)]
    files = [rng.choice([None, *keys]) for _ in range(20)] + [b"only in files"]
    got = run(spark, records, files, batch_rows=batch_rows, fingerprint_bits=bits, bucket_rows=40)
    assert got == brute(records, files)


def test_empty_and_null(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, None), (2, None), (3, b"a")], [None]) == set()
    assert run(spark, [], [b"a"]) == set()
    assert run(spark, [(1, b"a"), (2, b"a")], []) == {2}
    assert run(spark, [(1, b"a")], [b"a"]) == {1}


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that all collide, only the comparison of bytes decides."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(seen_keys.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    records = [(1, b"a"), (2, b"b"), (3, b"a"), (4, b"b"), (5, b"c"), (6, b"c")]
    for batch_rows in (1, 2, 3, 100):
        assert run(spark, records, [b"z"], batch_rows=batch_rows) == {3, 4, 6}


def test_rate(spark):
    r = spark.createDataFrame([(i, b"%d" % (i % 4000)) for i in range(8000)], "record_id bigint, key binary")
    f = spark.createDataFrame([], "key binary")
    one = seen_keys.wrong_rate(r, f, batch_rows=500, fingerprint_bits=8).first()
    assert one["lookups"] > 8000 and 0 < one["wrong_share"] < 4 / 256
    none = seen_keys.wrong_rate(r.limit(0), f).first()
    assert (none["lookups"], none["wrong_share"]) == (0, 0.0)


def test_sealed_partitions_decide_most_keys(spark):
    """By default, most keys seen before are found in a sealed partition, not in their own batch."""
    n = 1 << 17
    r = spark.range(n).select(F.col("id").alias("record_id"), F.expr(f"cast(cast(pmod(id * 7919, {n // 2 + 1}) as string) as binary)").alias("key"))
    f = spark.createDataFrame([], "key binary")
    looked, _ = seen_keys.lookup(r, f)
    seen = n - r.select("key").distinct().count()
    assert looked.where("claimed is not null").count() > 0.9 * seen
    assert seen_keys.seen_before(r, f).count() == seen


@pytest.mark.parametrize("first, last", [(0, 0), (5, 150_000), (0, 1_500_000), (3, 750_000_000), (10**15, 10**15 + 10**9)])
def test_batches_are_many_but_bounded(spark, first, last):
    size = seen_keys.batch_size(spark.createDataFrame([(first,), (last,), (None,)], "record_id bigint"))
    batches = last // size - first // size + 1
    assert batches <= seen_keys.MAX_BATCHES + 1 and (size == seen_keys.LEAST_BATCH or batches > seen_keys.MAX_BATCHES // 2 - 1)
    assert seen_keys.batch_size(spark.createDataFrame([], "record_id bigint")) == seen_keys.LEAST_BATCH


def test_rate_is_of_the_setting_of_the_query(spark, monkeypatch):
    from siltstone.llm import key_queries

    r = spark.createDataFrame([(i, b"%d" % (i % 50)) for i in range(100)], "record_id bigint, key binary")
    f = spark.createDataFrame([(b"%d" % i,) for i in range(0, 100, 3)], "key binary")
    monkeypatch.setattr(key_queries, "_tables", lambda *_: (r, f))
    settings, lookup = [], seen_keys.lookup
    monkeypatch.setattr(seen_keys, "lookup", lambda *a, **kw: (settings.append(kw), lookup(*a, **kw))[1])
    key_queries.p1_found(spark, "")
    key_queries.p1_wrong_rate(spark, "")
    assert settings[0] == settings[1]


def test_all_bytes_of_a_sealed_key_are_reported(spark):
    """Fingerprint, batch and row of its slot and its two hashes are 30 bytes, besides the perfect hash."""
    r = spark.createDataFrame([(i, b"%d" % i) for i in range(5000)], "record_id bigint, key binary")
    f = spark.createDataFrame([(b"x%d" % i,) for i in range(1000)], "key binary")
    row = seen_keys.wrong_rate(r, f, batch_rows=500).first()
    assert row["sealed_bytes"] > 30 * 6000
    assert row["sealed_keys"] == 6000 and 30 < row["bytes_per_key"] < 34


def test_sealed_partitions_outlive_a_run(spark, tmp_path):
    """Runs that know only the sealed partitions of those before; few bits make wrong claims, never misses."""
    rng = random.Random(12)
    keys = [b"", b"\x00", *(b"k%d" % i for i in range(700))]
    records = [(i, rng.choice([None, *keys])) for i in range(1500)]
    for bits in (32, 4):
        kept = seen_keys.SealedKeys(spark, str(tmp_path / str(bits)), bits=bits)
        got = set()
        for lo in range(0, 1500, 500):
            part = spark.createDataFrame([(i, k, "x") for i, k in records[lo : lo + 500]], "record_id bigint, key binary, bucket string")
            got |= {r[0] for r in kept.add(part).collect()}
            kept = seen_keys.SealedKeys(spark, str(tmp_path / str(bits)))
            if lo == 500:
                kept.merge()
                assert kept.table.read().groupBy("bucket").count().agg(F.max("count")).first()[0] == 1
        want = brute(records, [])
        assert got >= want and (bits == 4 or got == want)
        if bits == 4:
            assert 0 < len(got - want) < 1500 * 3 / 16
        sealed = kept.table.read().agg(F.sum("n"), F.sum(F.length("body"))).first()
        assert sealed[0] <= len(keys)
    assert kept.add(part.limit(0)).count() == 0


def test_python_sees_no_key(spark):
    """The columns of the function over a bucket; and there is a task for each bucket."""
    columns = []
    inner = seen_keys._bucket_lookup

    def watched(bits):
        return lambda table: inner(bits)(table if not columns.extend(table.column_names) else table)

    rows = [(1, 0, 5, 6, 0, False), (2, 1, 5, 6, 0, False)]
    records = spark.createDataFrame(rows, "record_id long, batch int, h1 long, h2 long, bucket int, shared boolean")
    out = watched(16)(records.toArrow())
    assert "key" not in columns and "key" not in out.column_names and out.column("claimed").to_pylist() == [None, 0]
    some = spark.createDataFrame([(1, b"a"), (2, b"a")], "record_id long, key binary")
    assert seen_keys.lookup(some, some.limit(0))[0].rdd.getNumPartitions() >= 8

"""Rules of changelog operators, against fixtures and a dictionary model."""

import random

import pytest

from siltstone.errors import InvalidInput
from siltstone.functions.bytes import bloom_contains, successor
from siltstone.operators import changelog as cl
from siltstone.operators.changelog import Bound

SCHEMA = "key binary, lsn bigint, op tinyint, value binary"


def log(spark, rows):
    return spark.createDataFrame([(k, n, 1 if v is not None else 2, v) for k, n, v in rows], SCHEMA)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_scan_is_sorted_and_newest_wins(spark):
    df = log(spark, [(b"delta", 1, b"d"), (b"alpha", 2, b"a"), (b"alpha", 3, b"a2"), (b"beta", 4, b"b")])
    assert pairs(cl.scan(df)) == [(b"alpha", b"a2"), (b"beta", b"b"), (b"delta", b"d")]


def test_ranges(spark):
    df = log(spark, [(k, i, b"v") for i, k in enumerate([b"apple", b"banana", b"cherry", b"date"])])
    keys = lambda lo, hi: [k for k, _ in pairs(cl.scan(df, lo, hi))]
    assert keys(Bound(b"banana"), Bound(b"cherry")) == [b"banana", b"cherry"]
    assert keys(Bound(b"cherry"), Bound()) == [b"cherry", b"date"]
    assert keys(Bound(), Bound(b"cherry", False)) == [b"apple", b"banana"]
    assert keys(Bound(b"apple", False), Bound(b"date", False)) == [b"banana", b"cherry"]
    assert keys(Bound(b"x"), Bound(b"z")) == []
    assert keys(Bound(b"z"), Bound(b"a")) == []


def test_deletes_and_ties(spark):
    df = log(spark, [(b"k", 5, b"alive"), (b"k", 5, None), (b"gone", 1, b"x"), (b"gone", 2, None), (b"e", 3, b"")])
    assert pairs(cl.scan(df)) == [(b"e", b"")]
    image = {bytes(r["key"]): r["op"] for r in cl.flush_image(df).collect()}
    assert image == {b"k": 2, b"gone": 2, b"e": 1}
    assert cl.point_get(df, b"gone").count() == 0
    assert cl.coverage_gaps(df, cl.flush_image(df)).count() == 0


def test_as_of(spark):
    df = log(spark, [(b"k", 1, b"v1"), (b"k", 3, b"v3"), (b"k", 5, b"v5")])
    assert pairs(cl.scan(df, lsn=4)) == [(b"k", b"v3")]
    assert pairs(cl.scan(df, lsn=0)) == []


def test_binary_order_and_prefix(spark):
    keys = [b"", b"\x00z", b"Z", b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff", b"\xff\xff"]
    df = log(spark, [(k, i, b"v") for i, k in enumerate(random.Random(1).sample(keys, len(keys)))])
    assert [k for k, _ in pairs(cl.scan(df))] == sorted(keys)
    for prefix in [b"", b"a", b"a\xff", b"\xff"]:
        want = [k for k in sorted(keys) if k.startswith(prefix)]
        assert [k for k, _ in pairs(cl.prefix_scan(df, prefix))] == want
        assert sorted(bytes(r["key"]) for r in cl.outside_namespace(df, prefix).collect()) == [
            k for k in sorted(keys) if not k.startswith(prefix)
        ]
    assert successor(b"a\xff") == b"b" and successor(b"\xff\xff") is None


def test_nulls_extra_columns_and_empty(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, b"x", 9), (b"k", None, 1, b"y", 9), (b"k", 2, 1, None, 9), (b"k", 2, 1, b"z", 9)],
        SCHEMA + ", _size int",
    )
    assert pairs(cl.scan(df)) == [(b"k", b"z")]
    empty = df.limit(0)
    assert cl.scan(empty).count() == 0
    assert cl.statistics(empty).first().asDict() == {"n_rows": 0, "n_keys": 0, "n_bytes": 0, "max_lsn": 0}


def test_commits(spark):
    df = spark.createDataFrame(
        [(b"a", 1, 1, b"x", 1), (b"b", 2, 1, b"y", 2), (b"c", 3, 1, b"z", None)], SCHEMA + ", txn_id bigint"
    )
    commits = spark.createDataFrame([(2,), (2,), (None,), (7,)], "txn_id bigint")
    assert pairs(cl.scan(cl.committed_only(df, commits))) == [(b"b", b"y"), (b"c", b"z")]


def test_batches(spark):
    rows = [(1, 0, 1, b"a", b"first"), (1, 1, 1, b"b", b"p"), (1, 2, 2, b"a", None), (1, 3, 1, b"a", b"last"), (2, 0, 2, b"b", None)]
    df = spark.createDataFrame(rows, "batch_id bigint, pos int, op tinyint, key binary, value binary")
    changes = cl.batch_to_changes(df, 10)
    assert sorted(r["lsn"] for r in changes.collect()) == [10, 11, 12, 13, 14]
    assert pairs(cl.scan(changes)) == [(b"a", b"last")]
    assert cl.oversized_batches(df).count() == 0


def test_reclaim(spark):
    df = log(spark, [(b"free", 3, None), (b"protected", 4, None), (b"z", 5, b"live")])
    for n in (0, 40):
        fill = [(bytes([1, i]), bytes([1, i + 1])) for i in range(n)]  # many ranges take the other path
        protected = spark.createDataFrame([(b"p", b"q"), *fill], "smallest_key binary, largest_key binary")
        kept = sorted(bytes(r["key"]) for r in cl.compact(df, protected).collect())
        assert kept == [b"protected", b"z"]
    none = spark.createDataFrame([], "smallest_key binary, largest_key binary")
    assert cl.compact(log(spark, [(b"a", 1, None)]), none).count() == 0


def test_overlaps_and_closure(spark):
    ranges = [(1, b"a", b"c"), (2, b"c", b"d"), (3, b"e", b"f"), (4, b"b", b"b"), (5, None, None)]
    kind = "file_id bigint, smallest_key binary, largest_key binary"
    got = {r[0]: (r[1], r[2]) for r in cl.overlaps(spark.createDataFrame(ranges, kind)).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (0, 2), 4: (1, 1)}
    files = [{"file_id": i, "lo": a, "hi": b} for i, a, b in ranges[:4]]
    assert cl.closure(files, {4}) == {1, 2, 4} and cl.closure(files, {3}) == {3} and cl.closure([], {9}) == {9}
    assert cl.overlaps(spark.createDataFrame([], kind)).count() == 0


def test_overlaps_against_pairs(spark):
    rng = random.Random(11)
    files = []
    for i in range(300):
        a, b = sorted(bytes([rng.randrange(40), rng.randrange(256)]) for _ in range(2))
        files.append((i, a, b if rng.random() < 0.1 else max(a, bytes([a[0], min(255, a[1] + 30)]))))
    df = spark.createDataFrame(files, "file_id bigint, smallest_key binary, largest_key binary")
    got = {r[0]: (r[1], r[2]) for r in cl.overlaps(df).collect()}
    meet = {i: {j for j, c, d in files if a <= d and c <= b} for i, a, b in files}
    assert {i: n for i, (n, _) in got.items()} == {i: len(m) - 1 for i, m in meet.items()}
    for i, a, _ in files[:20]:
        want = cl.closure([{"file_id": k, "lo": x, "hi": y} for k, x, y in files], {i})
        assert {j for j, (_, g) in got.items() if g == got[i][1]} == want


def test_cut_by_bytes(spark):
    df = log(spark, [(b"k%03d" % i, i, b"v" * (i % 7)) for i in range(200)])
    parts, upto = {}, 0
    for r in df.orderBy("key").collect():
        parts[bytes(r["key"])] = upto // 500
        upto += 62 + len(r["key"]) + len(r["value"])
    got = {bytes(r["key"]): r["part"] for r in cl.cut_by_bytes(df, 500).collect()}
    assert got == parts
    with pytest.raises(InvalidInput):
        cl.cut_by_bytes(df, 0)


def test_cut_in_place_is_greedy(spark):
    """Within a range a part ends where the next version would go beyond the target."""
    rng = random.Random(3)
    rows = [(b"k%04d" % i, i, b"v" * rng.choice([0, 5, 90, 700])) for i in range(400)]
    got = cl.cut_in_place(log(spark, rows).withColumn("part", cl.F.lit("clash")), 600, 3).collect()
    assert sorted(bytes(r["key"]) for r in got) == [k for k, _, _ in rows]
    assert [r["key"] for r in got] == sorted(r["key"] for r in got) and len({r["range"] for r in got}) > 1
    for n in {r["range"] for r in got}:
        held, part = 0, 0
        for r in sorted((r for r in got if r["range"] == n), key=lambda r: r["key"]):
            size = 62 + len(r["key"]) + len(r["value"])
            if held and held + size > 600:
                held, part = 0, part + 1
            held += size
            assert r["part"] == part


def test_gaps_show_every_difference(spark):
    changes = log(spark, [(b"a", 1, b"x"), (b"a", 2, b"y"), (b"b", 3, None), (b"c", 4, b""), (b"d", 5, b"d")])
    image = [(b"a", 2, b"y"), (b"b", 3, None), (b"c", 4, b""), (b"d", 5, b"d")]
    gaps = lambda rows: sorted({bytes(r["key"]) for r in cl.coverage_gaps(changes, log(spark, rows)).collect()})
    assert gaps(image) == []
    assert gaps(image[1:]) == [b"a"] and gaps([*image, image[0]]) == [b"a"]
    assert gaps([(b"a", 1, b"x"), *image[1:]]) == [b"a"]
    assert gaps([(b"a", 2, b"altered"), *image[1:3]]) == [b"a", b"d"]
    hashes = {log(spark, x).agg(cl.content_hash()).first()[0] for x in (image, image[::-1])}
    assert len(hashes) == 1
    assert log(spark, image[1:]).agg(cl.content_hash()).first()[0] not in hashes
    assert log(spark, []).agg(cl.content_hash()).first()[0] == 0


def test_cut_by_bytes_keeps_every_row(spark):
    """Many rows and adaptive execution: 60 MB in ranges that are joined together as it likes."""
    from pyspark.sql import functions as F

    n, target = 200_000, 2 << 20
    image = spark.range(n).select(
        F.md5(F.col("id").cast("string")).cast("binary").alias("key"), F.col("id").alias("lsn"),
        F.lit(1).cast("byte").alias("op"), F.repeat(F.lit("x"), 200).cast("binary").alias("value"),
    )
    parts = cl.cut_by_bytes(image, target).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in parts) == n
    assert sorted(r["part"] for r in parts) == list(range(-(-n * (62 + 32 + 200) // target)))
    placed = cl.cut_in_place(image, target, 4)
    files = placed.groupBy("range", "part").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in files) == n and max(r["n"] for r in files) * 294 <= target
    assert cl.coverage_gaps(image, placed).count() == 0


def test_random_against_model(spark):
    rng = random.Random(7)
    rows = [(bytes([rng.randrange(6)]), rng.randrange(40), rng.choice([None, b"", b"x", b"y"])) for _ in range(400)]
    best = {}
    for k, n, v in rows:
        rank = (n, 2 if v is None else 1, v is not None, v or b"")
        best[k] = max(best.get(k, rank), rank)
    want = sorted((k, r[3]) for k, r in best.items() if r[1] == 1)
    assert pairs(cl.scan(log(spark, rows))) == want


def test_references_and_checksums(spark):
    from pyspark.sql import functions as F

    index = spark.createDataFrame([(b"a", 1), (b"b", 2), (b"c", 3)], "key binary, ref bigint")
    values = spark.createDataFrame([(1, b"x"), (2, b"y")], "ref bigint, value binary").withColumn(
        "checksum", F.when(F.col("ref") == 2, F.lit(0)).otherwise(F.crc32("value"))
    )
    got = {bytes(r["key"]): r["ok"] for r in cl.resolve_references(index, values).collect()}
    assert got == {b"a": True, b"b": False, b"c": False}
    assert cl.bad_checksums(values).count() == 1


def test_bloom(spark):
    import hashlib

    keys, bits, hashes = [b"k%d" % i for i in range(50)], 701, 5
    data = bytearray(-(-bits // 8))
    places = lambda k: [
        ((int.from_bytes(hashlib.md5(k).digest()[:8], "big") + i * int.from_bytes(hashlib.md5(k).digest()[8:], "big")) % 2**64) % bits
        for i in range(hashes)
    ]
    for k in keys:
        for j in places(k):
            data[j // 8] |= 1 << (j % 8)
    others = [b"o%d" % i for i in range(200)]
    df = spark.createDataFrame([(k, bits, hashes, bytes(data)) for k in keys + others] + [(None, 1, 1, b"x"), (b"k", 8, 1, None)],
                               "key binary, bits bigint, hashes int, bloom binary")
    got = df.select("key", bloom_contains(df.key, df.bits, df.hashes, df.bloom).alias("has")).collect()
    for r in got[: len(keys + others)]:
        assert r["has"] == all(data[j // 8] >> (j % 8) & 1 for j in places(bytes(r["key"])))
    assert [r["has"] for r in got[-2:]] == [None, None]


def test_the_query_of_a_deleted_key_reads_the_whole_log(spark, monkeypatch):
    from siltstone.plans import changelog_queries as q

    rows = [(q.DEAD, 5, 1, b"old"), (q.DEAD, 7, 2, None), (b"other", 7, 1, b"x"), (b"other", 8, 2, None)]
    log = spark.createDataFrame(rows, "key binary, lsn long, op int, value binary")
    monkeypatch.setattr(q, "_log", lambda *_: log)
    assert q.kv_get_deleted(spark, "").first().asDict() == {"key_hex": q.DEAD.hex().upper(), "n_puts": 1, "n_deletes": 1, "n_found": 0}
    monkeypatch.setattr(q, "_log", lambda *_: log.where("op = 1"))
    assert q.kv_get_deleted(spark, "").first()["n_found"] == 1

"""Streams of change files."""

from siltstone.sources.shared import PublishedTable
from siltstone.streaming import changelog as stream

SCHEMA = "key binary, lsn bigint, op int, value binary"


def feed(spark, folder, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_maintained_table(spark, tmp_path):
    folder, table = str(tmp_path / "in"), PublishedTable(spark, str(tmp_path / "t"))
    feed(spark, folder, [(b"a", 2, 1, b"new"), (b"b", 1, 1, b"x")], [(b"a", 1, 1, b"late"), (b"b", 3, 2, None)])
    for more in (None, [(b"c", 9, 1, b"z")]):
        if more:
            feed(spark, folder, more)
        query = stream.maintain(stream.read_changes(spark, folder, SCHEMA, 1), table, str(tmp_path / "ck"))
        query.awaitTermination(60)
    got = {bytes(r["key"]): (r["lsn"], r["op"]) for r in table.read().collect()}
    assert got == {b"a": (2, 1), b"b": (3, 2), b"c": (9, 1)}


def test_keyed_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [(b"a", 2, 1, b"new"), (b"b", 1, 1, b"x")], [(b"a", 1, 1, b"late"), (b"b", 1, 2, None)])
    changes = stream.newest_versions(stream.read_changes(spark, folder, SCHEMA, 1))
    query = changes.writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [(bytes(r["key"]), r["lsn"], r["op"]) for r in spark.table("newest").collect()]
    assert rows.count((b"a", 2, 1)) == 1 and (b"b", 1, 2) in rows


def test_keyed_state_emits_changes_only(spark, tmp_path):
    """Equal lsns, nulls and empty values, late and repeated changes, and a query begun again."""
    folder = str(tmp_path / "in")
    batches = [
        [(b"a", 5, 1, b"x"), (b"b", 1, 1, None), (b"c", 1, 2, None), (b"d", 7, 1, b"\x7f"), (None, 1, 1, b"n"), (b"e", None, 1, b"n")],
        [(b"a", 5, 1, b"x"), (b"a", 4, 2, None), (b"b", 1, 1, b""), (b"c", 1, 1, b"z"), (b"d", 7, 1, b"\xff")],
        [(b"a", 5, 2, None), (b"b", 1, 1, None), (b"d", 7, 1, b"\x80"), (b"f", 2, 1, b"late")],
    ]
    emitted = []

    def keep(batch, number):
        emitted.append(sorted((bytes(r["key"]), r["lsn"], r["op"], r["value"] and bytes(r["value"])) for r in batch.collect()))

    for rows in batches:  # each by a query of its own, from the state of the one before
        feed(spark, folder, rows)
        changes = stream.newest_versions(stream.read_changes(spark, folder, SCHEMA, 1))
        assert changes.columns == ["key", "lsn", "op", "value"]
        query = (
            changes.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    assert [x for x in emitted if x] == [
        [(b"a", 5, 1, b"x"), (b"b", 1, 1, None), (b"c", 1, 2, None), (b"d", 7, 1, b"\x7f")],
        [(b"b", 1, 1, b""), (b"d", 7, 1, b"\xff")],
        [(b"a", 5, 2, None), (b"f", 2, 1, b"late")],
    ]


def test_keyed_state_runs_without_python_workers(spark, tmp_path):
    """A batch is merged with the state by the engine itself, not key by key in Python."""
    folder = str(tmp_path / "in")
    feed(spark, folder, [(b"a", 1, 1, b"x")])
    changes = stream.newest_versions(stream.read_changes(spark, folder, SCHEMA, 1))
    assert "Pandas" not in changes._jdf.queryExecution().logical().toString()

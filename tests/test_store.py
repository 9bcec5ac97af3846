"""The directory store, stored documents and the command language."""

import io
import random
import threading

import pytest

from siltstone import command, repl
from siltstone.config import Settings
from siltstone.errors import Corrupted, InvalidInput, StorageError
from siltstone.operators.changelog import Bound
from siltstone.sources import store as store_module
from siltstone.sources.documents import DOCUMENT, META, RESERVED, DocumentStore
from siltstone.sources.shared import list_dir, replace_text
from siltstone.sources.store import Delete, Put, Store, checked_batch, classify


def rows(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_batches_survive_reopening(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store.open(spark, root)
    store.write_batch([])
    assert store.sequence == 0
    store.write_batch([Put(b"a", b"first"), Put(b"b", b"x"), Delete(b"a"), Put(b"a", b"last"), Delete(b"b")])
    assert rows(store.scan()) == [(b"a", b"last")] and store.sequence == 5
    again = Store.open(spark, root)
    assert again.get(b"a") == b"last" and again.get(b"b") is None
    assert again.get(b"a", lsn=1) == b"first"
    again.close()
    with pytest.raises(StorageError):
        again.put(b"x", b"y")


def test_store_against_model(spark, tmp_path):
    rng, model = random.Random(5), {}
    store = Store.open(spark, str(tmp_path / "s"), Settings(target_sstable_bytes=300, level_base_bytes=600))
    for step in range(5):
        ops = []
        for _ in range(rng.randrange(1, 12)):
            key = b"k%d" % rng.randrange(12)
            if rng.random() < 0.3:
                ops.append(Delete(key))
                model.pop(key, None)
            else:
                ops.append(Put(key, b"v%d" % step))
                model[key] = b"v%d" % step
        store.write_batch(ops)
        store.flush()
    assert store.compact() >= 0 and store.maintenance_error is None
    store.compact_level(0)
    store.verify()
    assert rows(store.scan()) == sorted(model.items())
    assert rows(store.scan(Bound(b"k3"), Bound(b"k7", False))) == [x for x in sorted(model.items()) if b"k3" <= x[0] < b"k7"]
    deep = [(f["smallest_key"], f["largest_key"]) for f in store.level(1)]
    assert all(a[1] < b[0] for a, b in zip(sorted(deep), sorted(deep)[1:]))
    stats = store.clean()
    assert stats.live_rows == len(model) and rows(store.scan()) == sorted(model.items())
    assert rows(Store.open(spark, store.root).scan()) == sorted(model.items())


def test_all_deleted_leaves_no_file(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.write_batch([Put(b"a", b"x"), Delete(b"a")])
    store.flush()
    store.compact_level(0)
    assert store.files == [] and store.get(b"a") is None


def test_deletes_stay_while_they_hide_something(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.put(b"protected", b"old")
    store.flush()
    store.compact_level(0)
    store.compact_level(1)
    store.write_batch([Put(b"free", b"x"), Delete(b"free"), Delete(b"protected")])
    store.flush()
    store.compact_level(0)
    assert [bytes(r["key"]) for r in store._read(store.level(1)).collect()] == [b"protected"]
    assert store.get(b"protected") is None


def test_large_compaction_keeps_every_row(spark, tmp_path):
    """200,000 rows, 60 MB, files of 2 MiB, in the settings that a store has by itself."""
    from pyspark.sql import functions as F

    store = Store.open(spark, str(tmp_path / "s"))
    for k in range(2):
        rows = spark.range(k * 100_000, k * 100_000 + 100_000).select(
            F.md5(F.col("id").cast("string")).cast("binary").alias("key"), (F.col("id") + 1).alias("lsn"),
            F.lit(1).alias("op"), F.repeat(F.lit("x"), 200).cast("binary").alias("value"),
        )
        store.apply_versions(rows)
        assert store.maintenance_error is None
        assert store.scan().count() == (k + 1) * 100_000
    store.flush()
    store.compact_level(0)
    assert store.level(0) == [] and len(store.level(1)) >= 26
    assert all(f["bytes"] <= 2 << 20 for f in store.level(1))
    assert store.scan().count() == 200_000 and store.sequence == 200_000
    store.verify()
    assert Store.open(spark, store.root).files == store.files


def test_a_merge_that_loses_a_row_is_refused(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "s"))
    store.write_batch([Put(b"k%d" % i, b"x") for i in range(50)])
    store.flush()
    cut, before = store_module.cl.cut_in_place, store.files
    monkeypatch.setattr(store_module.cl, "cut_in_place", lambda *a: cut(*a).where("key <> X'6B37'"))
    with pytest.raises(Corrupted, match="6b37"):
        store.compact_level(0)
    assert store.files == before and store.scan().count() == 50
    monkeypatch.undo()
    store.compact_level(0)
    assert store.scan().count() == 50 and store.level(0) == []


def test_replaced_files_stay_for_those_who_began_before(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.put(b"a", b"x")
    lazy = store.scan()
    store.flush()
    store.compact_level(0)
    assert rows(lazy) == [(b"a", b"x")]
    old = store.manifest["dropped"][0][0]
    for i in range(store_module.RETAINED + 1):
        store.put(b"b%d" % i, b"y")
    assert list_dir(spark, f"{store.root}/{old}") == []


def test_the_manifest_in_full_comes_every_so_often(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "WHOLE_EVERY", 3)
    store = Store.open(spark, str(tmp_path / "s"), Settings(max_level0_files=10))
    for i in range(8):
        store.put(b"k%d" % i, b"v")
        again = Store.open(spark, store.root)
        assert again.manifest == store.manifest
    names = list_dir(spark, store.root)
    assert sum(n.startswith("whole-") for n in names) <= 2 and sum(n.startswith("step-") for n in names) <= 7
    replace_text(spark, f"{store.root}/whole-{store.manifest['version'] // 3 * 3:012d}.json", "{}")
    with pytest.raises(Corrupted):
        Store.open(spark, store.root)


def test_one_of_two_writers_fails(spark, tmp_path):
    """Many writers begin from one state: exactly one takes the next number."""
    root = str(tmp_path / "s")
    Store.open(spark, root)
    writers = [Store.open(spark, root) for _ in range(4)]
    outcomes: list = [None] * 4

    def write(i):
        try:
            writers[i].put(b"k", b"%d" % i)
            outcomes[i] = "stored"
        except StorageError:
            outcomes[i] = "refused"

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcomes) == ["refused"] * 3 + ["stored"]
    assert Store.open(spark, root).get(b"k") == b"%d" % outcomes.index("stored")


def test_threads_share_their_writes(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    threads = [threading.Thread(target=store.write_batch, args=([Put(b"k%d" % i, b"v"), Put(b"last", b"%d" % i)],)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.scan().count() == 13 and store.sequence == 24
    assert len(store.level(-1)) < 12
    ticket = store.submit([Put(b"queued", b"x")])
    assert not ticket.done()
    store.await_pending_writes()
    assert ticket.done() and store.get(b"queued") == b"x"
    last = store.submit([Put(b"at close", b"x")])
    store.close()
    assert last.done() and Store.open(spark, store.root).get(b"at close") == b"x"


def test_what_failed_writers_left_is_removed(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.put(b"a", b"x")
    left = tmp_path / "s" / "generation-000001" / "L0-left"
    left.mkdir()
    Store.open(spark, store.root)
    assert left.exists()  # it may still be written
    assert Store.open(spark, store.root, abandoned_after=0).get(b"a") == b"x"
    assert not left.exists()


def test_damage_is_found(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    store.write_batch([Put(b"a", b"x"), Put(b"b", b"y")])
    store.flush()
    store.verify()
    folder = f"{store.root}/{store.files[0]['path']}"
    altered = store._read(store.files).collect()
    spark.createDataFrame([(*altered[0][:3], b"z"), altered[1]], store_module.CHANGE).write.mode("overwrite").parquet(folder)
    with pytest.raises(Corrupted, match="content"):
        store.verify()


def test_files_have_bloom_filters_and_pages_of_the_settings(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), Settings(bloom_false_positive_rate=0.001))
    store.write_batch([Put(b"k%d" % i, b"v" * 50) for i in range(500)])
    store.flush()
    [name] = [n for n in list_dir(spark, f"{store.root}/{store.files[0]['path']}") if n.endswith(".parquet")]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store.root}/{store.files[0]['path']}/{name}")
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        assert columns.get(0).getBloomFilterOffset() > 0 and columns.get(1).getBloomFilterOffset() <= 0
    finally:
        reader.close()


def test_bulk_changes(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    df = spark.range(100).selectExpr(
        "id div 10 as batch_id", "cast(id % 10 as int) as pos", "cast(1 as tinyint) as op",
        "cast(cast(id % 7 as string) as binary) as key", "cast(cast(id as string) as binary) as value",
    )
    store.write_changes(df)
    assert store.sequence == 100 and dict(rows(store.scan()))[b"1"] == b"99"


def test_groups_and_given_versions(spark, tmp_path, monkeypatch):
    from siltstone.sources import store as module

    monkeypatch.setattr(module, "GROUP_BATCHES", 3)
    store = Store.open(spark, str(tmp_path / "s"))
    store.write_batches([[Put(b"k", b"%d" % i), Put(b"n%d" % i, b"x")] for i in range(7)] + [[]])
    assert store.sequence == 14 and len(store.level(-1)) == 3 and store.get(b"k") == b"6"
    with pytest.raises(InvalidInput):
        store.write_batches([[Put(b"good", b"x")], [Put(b"bad", b"x" * (64 << 20))]])
    assert store.get(b"good") is None
    given = spark.createDataFrame([(b"k", 3, 1, b"older"), (b"z", 40, 1, b"new"), (None, 1, 1, b"")], "key binary, lsn long, op int, value binary")
    store.apply_versions(given)
    assert store.get(b"k") == b"6" and store.get(b"z") == b"new" and store.sequence == 40


def test_failures_are_refused(spark, tmp_path):
    root = tmp_path / "s"
    store = Store.open(spark, str(root))
    store.put(b"a", b"x")
    other = Store.open(spark, str(root))
    other.put(b"b", b"y")
    with pytest.raises(StorageError):
        store.put(b"c", b"z")
    assert rows(Store.open(spark, str(root)).scan()) == [(b"a", b"x"), (b"b", b"y")]
    path = other.files[0]["path"]
    (root / path / "_SUCCESS").unlink()
    with pytest.raises(Corrupted):
        Store.open(spark, str(root))
    (root / "CURRENT").unlink()
    assert classify(spark, str(root)) == "incomplete"
    with pytest.raises(Corrupted):
        Store.open(spark, str(root))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "file").write_text("x")
    with pytest.raises(StorageError):
        Store.open(spark, str(tmp_path / "f"))
    with pytest.raises(InvalidInput):
        checked_batch([Put(b"k", b"x" * (64 << 20))])
    assert list_dir(spark, str(tmp_path / "none")) == []


@pytest.mark.parametrize("bad", [{"memtable_size_threshold": 1}, {"max_level0_files": 0}, {"level_size_multiplier": 1}, {"bloom_false_positive_rate": 1.0}])
def test_settings(bad):
    Settings().validate()
    with pytest.raises(InvalidInput):
        Settings(**bad).validate()


def kept(index):
    """What the kept index says, and that it says what the documents do."""
    assert index.verify().count() == 0
    stored = index.index()
    from siltstone.operators import fulltext as ft

    want = ft.build(index.documents()).statistics.first().asDict()
    assert stored.statistics.first().asDict() == want
    return want


def test_documents(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    index = DocumentStore.open(store)
    index.put_documents([("ship", b"Anchor chain, anchor."), ("dock", b"crane chain"), ("ship", b"sail chain chain")])
    ids = lambda words, every: [r["doc_id"] for r in index.search(words, every=every).collect()]
    assert ids(["sail", "chain"], True) == ["ship"] and ids(["anchor"], False) == [] and ids(["CHAIN"], True) == ["dock", "ship"]
    assert kept(index) == {"n": 2, "total": 5}
    index.put_document("ship", "sail 帆 sail sail".encode())
    index.put_document("blank", b"")
    assert kept(index) == {"n": 3, "total": 6} and ids(["chain"], False) == ["dock"] and ids(["帆"], False) == ["ship"]
    assert index.delete_document("ship") is True and index.delete_document("ship") is False
    assert index.get_document("dock") == b"crane chain" and index.get_document("ship") is None
    assert kept(index) == {"n": 2, "total": 2} and ids(["sail"], False) == []
    for _ in range(2):
        store.flush()
        store.compact_level(0)
    assert kept(index) == {"n": 2, "total": 2}
    with pytest.raises(InvalidInput):
        index.put_document("c", b"\xff")
    with pytest.raises(InvalidInput):
        index.write_batch([Put(b"free", b"x"), Put(RESERVED + b"x", b"y")])
    with pytest.raises(InvalidInput):
        index.get(META)
    index.put(b"free", b"x")
    assert rows(index.scan()) == [(b"free", b"x")]
    assert [r["doc_id"] for r in DocumentStore.open(Store.open(spark, store.root)).search_ranked(["crane"], every=False).collect()] == ["dock"]


def test_a_table_of_documents(spark, tmp_path):
    from siltstone.operators import fulltext as ft

    index = DocumentStore.open(Store.open(spark, str(tmp_path / "s")))
    texts = {f"d{i:03d}": " ".join(f"w{(i * k) % 13}" for k in range(i % 9)) for i in range(120)}
    table = spark.createDataFrame([(0, i, t) for i, t in texts.items()], "pos int, doc_id string, document string")
    index.apply_documents(table)
    more = [(1, "d005", "changed w1"), (0, "d005", "w2"), (1, "d006", None), (1, "new", "w1 w1"), (1, "none", None)]
    index.apply_documents(spark.createDataFrame(more, table.schema))
    texts |= {"d005": "changed w1", "new": "w1 w1"}
    del texts["d006"]
    kept(index)
    plain = ft.build(spark.createDataFrame(list(texts.items()), "doc_id string, document string"))
    for every in (True, False):
        want = ft.search_ranked(plain, ["w1", "w4"], every=every, limit=20).collect()
        assert index.search_ranked(["w1", "w4"], every=every, limit=20).collect() == want and want
        assert index.search(["w1 w4"], every=every, limit=7).collect() == ft.search(plain, ["w1", "w4"], every=every, limit=7).collect()
    with pytest.raises(InvalidInput):
        index.apply_documents(spark.createDataFrame([(1, "", "x")], table.schema))


def test_a_hit_without_document_fails_the_search(spark, tmp_path):
    index = DocumentStore.open(Store.open(spark, str(tmp_path / "s")))
    index.put_documents([("x", b"word"), ("y", b"word")])
    index.store.delete(DOCUMENT + b"x")
    for run in (index.search, index.search_ranked):
        with pytest.raises(Exception, match="no document: x"):
            run(["word"], every=False).collect()
    assert {r["rule"] for r in index.verify().collect()} == {"posting", "length"}


@pytest.mark.parametrize("meta", [bytes([1, 1]), bytes([2, 1]), bytes([3, 99]), None])
def test_document_versions(spark, tmp_path, meta):
    store = Store.open(spark, str(tmp_path / "s"))
    store.put(DOCUMENT + b"x", b"orphan") if meta is None else store.put(META, meta)
    with pytest.raises(Corrupted):
        DocumentStore.open(store)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('batch set k1 "a b" DELETE k2 Set k3 v delete k4', ("BATCH", 4)),
        ("del lighthouse", ("DELETE", 1)),
        ("Set 'two words' \\n", ("SET", 2)),
        ('fts rank or "harbour Ω"', ("RANK", 2)),
        ("FTS AND tide table", ("SEARCH", 2)),
        ("set k'v'", ("SET", 2)),
        ("exit", ("EXIT", 0)),
    ],
)
def test_commands(line, want):
    got = command.parse(line)
    assert (got.name, len(got.args)) == want


@pytest.mark.parametrize(
    "line",
    ["BATCH SET valid value DELETE", "BATCH DEL x", "BATCH", "FTS RANK", "FTS RANK XOR x", "FTS RANK AND", "FTS RANK AND a b",
     "SET k", "GET", "DOC PUT x", "DOC", "FTS", 'GET "x', "NOPE"],
)
def test_bad_commands(line):
    with pytest.raises(command.ParseError):
        command.parse(line)


def test_session(spark, tmp_path):
    root = str(tmp_path / "s")
    out = io.StringIO()
    engine = DocumentStore.open(Store.open(spark, root))
    lines = ['set "tide table" "höchste Flut"', "", "doc put log 'Öl on deck'", "fts rank and deck", "fts or öl", "jump", "quit", "GET x"]
    repl.run(engine, io.StringIO("\n".join(lines)), out)
    assert out.getvalue().splitlines() == ["OK", "OK", r"0.287682	log	\u{d6}l on deck", r"log	\u{d6}l on deck", "ERR unknown command: jump", "bye"]
    again = DocumentStore.open(Store.open(spark, root))
    assert command.respond(again, "GET 'tide table'") == "höchste Flut"
    assert command.respond(again, "FTS AND absent") == "(no results)"
    assert command.respond(again, "DOC DELETE none") == "OK" and command.respond(again, "GET none") == "(nil)"
    with pytest.raises(StorageError, match="unsupported"):
        command.execute(again.store, command.parse("DOC GET x"))


def test_command_line():
    folder, level, settings = repl.options(["-d", "/x", "--memtable-size-mb", "8", "--bloom-fp-rate", "0.1", "-v"])
    assert (folder, level) == ("/x", "DEBUG")
    assert (settings.memtable_size_threshold, settings.bloom_false_positive_rate) == (8 << 20, 0.1)
    assert repl.options(["/y"]) == ("/y", "ERROR", Settings())
    with pytest.raises(InvalidInput):
        repl.options(["--max-level0-files", "0"])
    with pytest.raises(SystemExit):
        repl.options(["--log-level", "loud"])


def test_unknown_format(spark, tmp_path):
    root = str(tmp_path / "s")
    Store.open(spark, root)
    replace_text(spark, f"{root}/STORE", '{"format": 99}')
    with pytest.raises(Corrupted):
        Store.open(spark, root)

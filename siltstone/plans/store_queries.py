"""Queries that run the stores themselves: writes, flush, compaction, rewrite, streams, commands.

Each call works in a folder of its own under the session's shared folder, so that its
result stays readable whatever runs later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone import command
from siltstone.config import Settings
from siltstone.operators import upsert
from siltstone.operators.changelog import Bound
from siltstone.plans import changelog_queries as cq
from siltstone.plans import fulltext_queries as fq
from siltstone.plans import upsert_queries as uq
from siltstone.sources.documents import DocumentStore
from siltstone.sources.shared import PublishedTable, read_table, shared_dir
from siltstone.sources.store import Store
from siltstone.streaming import changelog as streams

#: Small files, so that a merge of the test tables makes many of them.
SMALL = Settings(target_sstable_bytes=8 << 10, level_base_bytes=1 << 20)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def register(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cq._log(spark, sf_dir).select("key", "lsn", "op", "value", "arrival_no")


def _filled(spark: SparkSession, sf_dir: str, settings: Settings = SMALL) -> Store:
    """A store that took over the log in two writes, the late half first."""
    store = Store.open(spark, _folder(spark, "store"), settings)
    log = _versions(spark, sf_dir)
    half = log.agg((F.max("arrival_no") / 2).cast("long")).first()[0] or 0
    store.apply_versions(log.where(F.col("arrival_no") > half))
    store.apply_versions(log.where(F.col("arrival_no") <= half))
    return store


def _checked(store: Store) -> Store:
    """The store as another reader opens it, all its files compared with the manifest."""
    if store.maintenance_error:
        raise store.maintenance_error
    again = Store.open(store.spark, store.root, store.settings)
    again.verify()
    return again


@_query("kv_store_compacted", cq._latest_sql())
def kv_store_compacted(spark, sf_dir):
    """Flush, two compactions of level 0 and one of level 1, reopened: all live keys."""
    store = _filled(spark, sf_dir)
    store.flush()
    store.compact_level(0)
    store.compact_level(1)
    return cq._pairs(_checked(store).scan())


@_query("kv_store_asof", cq._latest_sql(f"and lsn <= {cq.AS_OF}"))
def kv_store_asof(spark, sf_dir):
    """A read at an earlier sequence number, while the log still holds all versions."""
    store = _filled(spark, sf_dir, Settings(memtable_size_threshold=1 << 40))
    return cq._pairs(store.scan(lsn=cq.AS_OF))


@_query(
    "kv_store_range",
    cq._latest_sql(f"and key > {cq._blob(cq.LOW)} and key <= {cq._blob(cq.HIGH)} and hex(key) not like '{cq.PREFIX.hex().upper()}%'"),
)
def kv_store_range(spark, sf_dir):
    """A range of a compacted store whose sessions were deleted again by a batch table."""
    store = _filled(spark, sf_dir)
    store.flush()
    store.compact_level(0)
    gone = store.prefix_scan(cq.PREFIX).select(F.lit(2).alias("op"), "key", F.lit(None).cast("binary").alias("value"))
    store.write_at_once(gone)
    store.flush()
    store.compact_level(0)
    return cq._pairs(_checked(store).scan(Bound(cq.LOW, False), Bound(cq.HIGH)))


@_query("kv_store_batches", cq.ORACLE_SQL["kv_batch_last_op_wins"])
def kv_store_batches(spark, sf_dir):
    """Segments written as batches in order of arrival, then flushed: the last operation holds."""
    store = Store.open(spark, _folder(spark, "store"), SMALL)
    place = F.row_number().over(W.partitionBy("segment_id").orderBy("arrival_no")) - 1
    store.write_changes(
        cq._log(spark, sf_dir)
        .where(F.col("key").isNotNull())
        .select("key", "op", "value", F.col("segment_id").alias("batch_id"), place.alias("pos"))
    )
    store.flush()
    return cq._pairs(_checked(store).scan())


@_query(
    "kv_store_cleaned",
    cq._latest_sql(
        out="""
select count(*) as live_rows, sum(octet_length(key) + octet_length(value))::bigint as live_bytes,
    sum(octet_length(value))::bigint as value_bytes, max(lsn) as max_lsn, 2::bigint as generation,
    count(*) as n_found from held where op = 1
"""
    ),
)
def kv_store_cleaned(spark, sf_dir):
    """What a full rewrite reports, and the rows that the new generation holds."""
    store = _filled(spark, sf_dir)
    stats = store.clean()
    found = _checked(store).scan().agg(F.count("*").alias("n_found"))
    numbers = {k: getattr(stats, k) for k in ("live_rows", "live_bytes", "value_bytes", "max_lsn", "generation")}
    return found.select(*[F.lit(v).cast("long").alias(k) for k, v in numbers.items()], "n_found")


@_query(
    "kv_store_manifest",
    cq._latest_sql(
        out="""
select 1 as level, count(*) as n_rows, sum(octet_length(key) + coalesce(octet_length(value), 0))::bigint as n_bytes,
    hex(min(key)) as smallest_hex, hex(max(key)) as largest_hex, true as disjoint from held where op = 1
"""
    ),
)
def kv_store_manifest(spark, sf_dir):
    """The entries of level 1 after all was compacted: their sums, and that no two overlap."""
    store = _filled(spark, sf_dir)
    store.flush()
    store.compact_level(0)
    files = sorted(_checked(store).files, key=lambda f: f["smallest_key"])
    row = (
        max(f["level"] for f in files), sum(f["record_count"] for f in files), sum(f["bytes"] for f in files),
        files[0]["smallest_key"], max(f["largest_key"] for f in files),
        all(a["largest_key"] < b["smallest_key"] for a, b in zip(files, files[1:])) and len(files) > 1,
    )
    kind = "level int, n_rows long, n_bytes long, smallest_hex string, largest_hex string, disjoint boolean"
    return spark.createDataFrame([row], kind)


#: Command lines and what is printed for each.
_SESSION = [
    ("SET port harbour", "OK"), ("set 'two words' \"a \\\" b\"", "OK"), ("GET port", "harbour"),
    ("GET 'two words'", 'a " b'), ("BATCH SET a 1 DELETE port SET a 2", "OK"), ("get port", "(nil)"), ("GET a", "2"),
    ("DEL a", "OK"), ("GET a", "(nil)"), ("DOC PUT d1 'red tide'", "OK"), ("DOC PUT d2 'tide tide'", "OK"),
    ("DOC GET d1", "red tide"), ("FTS AND tide red", "d1\tred tide"), ("FTS OR TIDE", "d1\tred tide\nd2\ttide tide"),
    ("DOC DELETE d1", "OK"), ("FTS OR red", "(no results)"), ("DOC GET d1", "(nil)"), ("FTS AND tide", "d2\ttide tide"),
    ("GET", "ERR usage: GET <key>"), ("SAIL", "ERR unknown command: SAIL"), ("GET 'x", "ERR unterminated quoted value"),
    ("quit", "bye"),
]


@_query(
    "kv_commands",
    "select * from (values "
    + ", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}')" for i, (_, a) in enumerate(_SESSION, 1))
    + ") t(line_no, answer)",
)
def kv_commands(spark, sf_dir):
    """The answers to a session of commands on a new store."""
    engine = DocumentStore.open(Store.open(spark, _folder(spark, "commands")))
    answers = [(i, command.respond(engine, line)) for i, (line, _) in enumerate(_SESSION, 1)]
    return spark.createDataFrame(answers, "line_no int, answer string")


def _change_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a folder of change files, read as a stream of some files at a time."""
    folder = _folder(spark, "changes")
    rows = cq._log(spark, sf_dir).select("key", "lsn", "op", "value")
    rows.repartition(6).write.parquet(folder)
    return streams.read_changes(spark, folder, rows.schema, files_per_trigger=2)


@_query("kv_stream_state", cq._latest_sql(out=cq._VERSIONS))
def kv_stream_state(spark, sf_dir):
    """The table that a stream of change files keeps, tombstones included."""
    table = PublishedTable(spark, _folder(spark, "streamed"))
    streams.maintain(_change_files(spark, sf_dir), table, _folder(spark, "checkpoint")).awaitTermination()
    return cq._versions(table.read())


@_query("kv_stream_newest", cq._latest_sql(out=cq._VERSIONS))
def kv_stream_newest(spark, sf_dir):
    """The last version that the keyed state emits for each key."""
    folder = _folder(spark, "emitted")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number}")

    running = (
        streams.newest_versions(_change_files(spark, sf_dir))
        .writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", _folder(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    emitted = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    last = emitted.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "number").alias("v"))
    return cq._versions(last.select("key", "v.*"))


@_query("p4_resumed", uq.ORACLE_SQL["p4_state"])
def p4_resumed(spark, sf_dir):
    """The feed in two parts, the second applied onto the published state of the first."""
    wal = read_table(spark, sf_dir, "wal_records").withColumnRenamed("record_type", "op")
    commits = read_table(spark, sf_dir, "wal_commits")
    half = wal.agg((F.max("arrival_no") / 2).cast("long")).first()[0] or 0
    table = PublishedTable(spark, _folder(spark, "wal_state"))
    table.publish(upsert.apply_changes(wal.where(F.col("arrival_no") > half), commits))
    done = table.current()["generation"]
    more = upsert.apply_changes(wal.where(F.col("arrival_no") <= half), commits, onto=table.read())
    return uq.shown(table.publish(more, expected=done))


def _documents(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """A store of all documents, to which the replacements and deletes were then applied."""
    engine = DocumentStore.open(Store.open(spark, _folder(spark, "documents"), Settings(target_sstable_bytes=1 << 20)))
    engine.apply_documents(fq._docs(spark, sf_dir).where(F.col("document").isNotNull()).withColumn("pos", F.lit(0)))
    engine.apply_documents(fq._changes(spark, sf_dir))
    engine.store.flush()
    engine.store.compact_level(0)
    return engine


@_query("fts_store_ranked", fq.ORACLE_SQL["fts_delete"])
def fts_store_ranked(spark, sf_dir):
    """Ranked search by the kept index of a store, after replacements and deletes."""
    found = _documents(spark, sf_dir).search_ranked(fq.PAIR, every=False, limit=100)
    return found.withColumn("score", F.round("score", 9))


@_query("fts_store_boolean", fq._CHANGED_BASE + fq._bool_sql(fq.PAIR, True, 100))
def fts_store_boolean(spark, sf_dir):
    return _documents(spark, sf_dir).search(fq.PAIR, every=True, limit=100)


@_query("fts_store_verify", fq._CHANGED_BASE + "select 'posting' as rule, doc_id, term from postings where term = 'bill'")
def fts_store_verify(spark, sf_dir):
    """What the kept index lacks after the entries of one term were deleted behind its back."""
    from siltstone.sources.documents import POSTING

    engine = _documents(spark, sf_dir)
    gone = engine.store.prefix_scan(POSTING + b"bill\x00")
    engine.store.write_at_once(gone.select(F.lit(2).alias("op"), "key", F.lit(None).cast("binary").alias("value")))
    return engine.verify()

"""Current state of a table from a change feed, by DuckDB upserts per bucket.

Each task holds an embedded DuckDB table with the key as primary key. A batch of
changes is upserted with a conflict clause that compares the stored sequence, so
repeated and late changes alter nothing; deletes stay as tombstones, or an older
put arriving later would bring the key back. The same upsert runs twice: first
over whatever rows a task has, which leaves at most one row per key and task to
shuffle however hot a key is, then once per bucket of keys. The buckets' results
are published at once. A later feed is applied onto the published state: its rows are
upserted like changes, so what was stored in an earlier run holds against late ones.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.shared import PublishedTable, checkpointed, stacked

PUT, DELETE = 1, 2

STATE = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("op", T.ByteType()),
        T.StructField("value", T.BinaryType()),
    ]
)

#: Rows and bytes that are gathered before one upsert statement runs.
STATEMENT_ROWS, STATEMENT_BYTES = 100_000, 32 << 20
#: Keys and value bytes that a task keeps before the first, unbucketed pass hands on what it has.
LOCAL_KEYS, LOCAL_BYTES = 250_000, 64 << 20
#: Changes and bytes of a bucket; memory of a task's database, beyond which it spills.
BUCKET_ROWS, BUCKET_BYTES, MEMORY = 500_000, 256 << 20, "1GB"

_CREATE = """
create or replace table state
    (bucket integer, key blob primary key, lsn bigint, op tinyint, value blob)
"""
#: Within a statement one row per key may come in: the newest, a delete before a
#: put of equal lsn, then the larger value (null smallest).
_UPSERT = """
insert into state
select bucket, key, lsn, op, value from changes
qualify row_number() over (partition by key order by lsn desc, op desc, value desc nulls last) = 1
on conflict (key) do update
    set lsn = excluded.lsn, op = excluded.op, value = excluded.value
    where excluded.lsn > state.lsn
       or (excluded.lsn = state.lsn and excluded.op > state.op)
       or (excluded.lsn = state.lsn and excluded.op = state.op
           and excluded.value is not null
           and (state.value is null or excluded.value > state.value))
"""


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= STATEMENT_ROWS or size >= STATEMENT_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _upserts(whole: bool):
    """The upsert over one task's rows; ``whole`` keeps all keys until the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # spilled to the folder that Spark gave its executor for such files
        spill = f"{os.environ.get('SPARK_LOCAL_DIRS', os.getcwd()).split(',')[0]}/duckdb-{uuid.uuid4().hex}"
        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill})
        db.execute(_CREATE)

        def export() -> Iterator[pa.RecordBatch]:
            yield from db.sql("select bucket, key, lsn, op, value from state").to_arrow_reader(20_000)

        taken = 0
        for changes in _gathered(batches):
            taken += changes.nbytes
            db.register("changes", changes)
            db.execute(_UPSERT)
            db.unregister("changes")
            if not whole and (
                taken >= LOCAL_BYTES
                or db.execute("select count(*) from state").fetchall()[0][0] >= LOCAL_KEYS
            ):
                yield from export()
                db.execute(_CREATE)
                taken = 0
        yield from export()
        db.close()
        shutil.rmtree(spill, ignore_errors=True)

    return run


#: Bytes of transaction ids that are broadcast at most.
COMMIT_BYTES = 32 << 20


def committed_changes(changes: DataFrame, commits: DataFrame | None) -> DataFrame:
    """Changes outside transactions and those of committed transactions.

    Rows without transaction skip the join: as null keys they would all meet in one
    task of it. The ids of committed transactions are counted first; while they are no
    more than ``COMMIT_BYTES`` they are broadcast and no value is shuffled.
    """
    if commits is None:
        return changes
    done = checkpointed(commits.where(F.col("txn_id").isNotNull()).select("txn_id").distinct())
    if done.count() * 16 <= COMMIT_BYTES:
        done = F.broadcast(done)
    within = changes.where(F.col("txn_id").isNotNull()).join(done, "txn_id", "left_semi")
    return stacked(changes.where(F.col("txn_id").isNull()), within.select(*changes.columns))


def bucket_count(rows: int, size: int = 0) -> int:
    """Buckets so that each gets about ``BUCKET_ROWS`` changes and ``BUCKET_BYTES`` at most."""
    return max(8, -(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES))


def apply_changes(
    changes: DataFrame,
    commits: DataFrame | None = None,
    *,
    onto: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """State after all changes: key, lsn, op, value and bucket, tombstones included.

    ``changes`` needs key, lsn, op and value, and txn_id if ``commits`` is given;
    other columns are ignored. Of a key the change with the highest lsn holds, a
    delete before a put of equal lsn, then the larger value. A row with null key,
    null lsn or an op other than put and delete is no change. An empty key is a
    key, an empty value a value. Repeated rows and empty tables are fine.

    ``onto`` is the state that an earlier call gave. A feed in any number of parts, in
    any order, gives the state of the whole feed; a change counts if its transaction is
    in the commits of the call that it comes with.
    """
    feed = changes.where(
        F.col("key").isNotNull() & F.col("lsn").isNotNull() & F.col("op").isin(PUT, DELETE)
    )
    size = F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0))
    if buckets is None:
        parts = [feed] if onto is None else [feed, onto]
        sums = [df.agg(F.count("*"), size).first() for df in parts]
        buckets = bucket_count(sum(r[0] for r in sums), sum(r[1] for r in sums))
    need = ["key", "lsn", "op", "value"] + (["txn_id"] if commits is not None else [])
    feed = committed_changes(feed.select(*need), commits)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.select(
            F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"),  # the partition it gets below
            "key",
            F.col("lsn").cast("long").alias("lsn"),
            F.col("op").cast("byte").alias("op"),
            "value",
        )

    local = bucketed(feed).mapInArrow(_upserts(whole=False), STATE)
    if onto is not None:  # one row per key already
        local = stacked(bucketed(onto), local)
    return local.repartition(buckets, "key").mapInArrow(_upserts(whole=True), STATE)


def publish_state(state: DataFrame, table: PublishedTable) -> DataFrame:
    """Publish the buckets' results, tombstones included, as one generation."""
    return table.publish(state)


def live_rows(state: DataFrame) -> DataFrame:
    """Keys that exist: those whose holding change is a put."""
    return state.where(F.col("op") == PUT)

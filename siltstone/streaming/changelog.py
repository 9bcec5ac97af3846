"""Structured Streaming over a folder of change files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.operators import changelog as cl
from siltstone.sources.shared import PublishedTable, stacked


def read_changes(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """The change files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def maintain(changes: DataFrame, table: PublishedTable, checkpoint: str) -> StreamingQuery:
    """Keep a published table at the state after all changes read so far.

    Each micro-batch is merged with the state, deletes kept, and published at once.
    A batch that is repeated after a failure changes nothing, as the merge depends
    on the set of versions only; the batch number is noted with each publication.
    """

    def merge(batch: DataFrame, number: int) -> None:
        now = table.current()
        if now is not None and now.get("batch", -1) >= number:
            return
        rows = batch.select("key", "lsn", "op", "value")
        state = rows if now is None else stacked(table.read(), rows)
        table.publish(cl.latest(state, keep_deletes=True), batch=number)

    return (
        changes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_versions(changes: DataFrame) -> DataFrame:
    """(key, lsn, op, value) whenever the holding version of a key changes, by keyed state.

    The state of a key is the holding version, deletes included, and the time of the
    batch that brought it, so late and repeated changes emit nothing. Use with output
    mode ``update``.
    """
    rows = changes.where(F.col("key").isNotNull() & F.col("lsn").isNotNull()).select(
        "key", "lsn", F.col("op").cast("int").alias("op"), "value"
    )
    # the time of a batch is one and the same within it; of equal versions the earliest holds
    since = -F.unix_micros(F.current_timestamp())
    dated = rows.withColumn("since", since)
    held = dated.groupBy("key").agg(F.max(F.struct("lsn", "op", "value", "since")).alias("held"))
    fresh = held.where(F.col("held.since") == since)
    return fresh.select("key", "held.lsn", "held.op", "held.value")

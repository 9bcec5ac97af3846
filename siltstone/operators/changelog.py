"""Operators on changelogs: rows (key, lsn, op, value), op 1 for put and 2 for delete.

Of a key the row with the highest lsn holds, a delete before a put of equal lsn,
then the larger value. Deletes are dropped only after that choice. Keys are ordered
as unsigned bytes, which is Spark's order of binaries. Rows with null key or lsn are
no changes. Other columns are carried along unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.errors import InvalidInput
from siltstone.functions.bytes import FRAME, frame_bytes, starts_with
from siltstone.operators.ordered import RANGE, in_ranges, running
from siltstone.sources.shared import stacked

PUT, DELETE = 1, 2
#: Largest payload of one operation and largest transaction, in bytes.
MAX_FRAME, MAX_TRANSACTION = 64 << 20, 256 << 20


@dataclass(frozen=True)
class Bound:
    """One side of a key range; a missing key leaves the side open."""

    key: bytes | None = None
    included: bool = True


def as_of(changes: DataFrame, lsn: int) -> DataFrame:
    """Versions that a reader at a sequence number sees."""
    return changes.where(F.col("lsn") <= lsn)


def latest(changes: DataFrame, *, keep_deletes: bool = False) -> DataFrame:
    """The holding version of each key.

    The rank window limits each task's rows to one per key before the shuffle, so
    a hot key is shuffled once per task.
    """
    newest = W.partitionBy("key").orderBy(
        F.desc("lsn"), F.desc("op"), F.desc_nulls_last("value")
    )
    held = (
        changes.where(F.col("key").isNotNull() & F.col("lsn").isNotNull())
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
    return held if keep_deletes else held.where(F.col("op") == PUT)


def in_range(low: Bound = Bound(), high: Bound = Bound(), key: str = "key") -> Column:
    """Predicate of a key range; both sides reach the Parquet scan."""
    k, test = F.col(key), F.lit(True)
    if low.key is not None:
        test = test & ((k >= F.lit(low.key)) if low.included else (k > F.lit(low.key)))
    if high.key is not None:
        test = test & ((k <= F.lit(high.key)) if high.included else (k < F.lit(high.key)))
    return test


def scan(
    changes: DataFrame,
    low: Bound = Bound(),
    high: Bound = Bound(),
    *,
    lsn: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """(key, value) of live keys within a range, ascending; an inverted range is empty."""
    seen = changes.where(in_range(low, high))
    if lsn is not None:
        seen = as_of(seen, lsn)
    rows = latest(seen).select("key", "value")
    return rows.orderBy("key") if ordered else rows


def prefix_scan(changes: DataFrame, prefix: bytes, *, lsn: int | None = None) -> DataFrame:
    """(key, value) of live keys with a prefix, ascending."""
    seen = changes.where(starts_with(F.col("key"), prefix))
    return scan(seen, lsn=lsn)


def point_get(changes: DataFrame, key: bytes, *, lsn: int | None = None) -> DataFrame:
    """One row (key, value), or none if the key is deleted or unknown."""
    return scan(changes.where(F.col("key") == F.lit(key)), lsn=lsn, ordered=False)


def outside_namespace(rows: DataFrame, prefix: bytes) -> DataFrame:
    """Rows whose key lies outside a reserved prefix."""
    return rows.where(~starts_with(F.col("key"), prefix))


def committed_only(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changes of committed transactions and those written outside any."""
    done = commits.where(F.col("txn_id").isNotNull()).select("txn_id").distinct()
    within = changes.where(F.col("txn_id").isNotNull()).join(done, "txn_id", "left_semi")
    return stacked(changes.where(F.col("txn_id").isNull()), within.select(*changes.columns))


def batch_to_changes(batches: DataFrame, first_lsn: int = 1) -> DataFrame:
    """Changes of batches (batch_id, pos, op, key, value): each operation takes the next lsn.

    Positions count from 0 within a batch. The lsn of an operation is the first lsn,
    plus the operations of all earlier batches, plus its position; the sizes of batches
    are summed over range by range. A row without batch_id is no operation.
    """
    sizes = batches.where(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.count("*").alias("_n"))
    upto = running(in_ranges(sizes, "batch_id"), ["batch_id"], "_upto", F.col("_n"))
    offsets = upto.select("batch_id", (F.col("_upto") - F.col("_n")).alias("_ahead"))
    return batches.join(offsets, "batch_id").select(
        "key", (F.lit(first_lsn) + F.col("_ahead") + F.col("pos")).cast("long").alias("lsn"),
        "op", "value", "batch_id",
    )


def oversized_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, bytes, largest) of batches that are refused for their size."""
    payload = F.lit(42) + F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    sizes = batches.groupBy("batch_id").agg(
        (F.sum(frame_bytes(F.col("key"), F.col("value"))) + 37).alias("bytes"),
        F.max(payload).alias("largest"),
    )
    return sizes.where((F.col("bytes") > MAX_TRANSACTION) | (F.col("largest") > MAX_FRAME))


def flush_image(changes: DataFrame) -> DataFrame:
    """What a flush writes: one version per key, deletes included."""
    return latest(changes, keep_deletes=True)


def coverage_gaps(changes: DataFrame, image: DataFrame) -> DataFrame:
    """Versions (key, lsn, op) in which an image differs from what the changes leave.

    No rows for a right flush. A version counts as often as it stands there, and its
    value by 64 bits of hash: a lost, doubled, older or altered one is a gap.
    """
    return image_gaps(flush_image(changes), image)


def image_gaps(want: DataFrame, have: DataFrame) -> DataFrame:
    """Versions (key, lsn, op) that stand in one of two images more often than in the other."""
    version = ["key", "lsn", "op"]
    content = F.xxhash64("value").alias("content")  # a null is not an empty value: it leaves the seed
    rows = stacked(
        want.select(*version, F.when(F.col("value").isNotNull(), content).alias("content"), F.lit(1).alias("d")),
        have.select(*version, F.when(F.col("value").isNotNull(), content).alias("content"), F.lit(-1).alias("d")),
    )
    sums = rows.groupBy(*version, "content").agg(F.sum("d").alias("d"))
    return sums.where(F.col("d") != 0).select(*version).distinct()


def content_hash() -> Column:
    """Aggregate over versions: one number for their set, whatever their order and files."""
    row = F.xxhash64(
        F.col("key"), F.col("lsn").cast("long"), F.col("op").cast("int"), F.col("value").isNull(), F.col("value")
    )
    return F.coalesce(F.bit_xor(row), F.lit(0))


def key_ranges(tables: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, smallest_key, largest_key, record_count) of each file."""
    return tables.groupBy(by).agg(
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.count("*").alias("record_count"),
    )


#: Ranges that are tested in a plain expression; more are met along the order of keys.
_FEW_RANGES = 32


def reclaim_deletes(merged: DataFrame, protected: DataFrame) -> DataFrame:
    """``merged`` without the deletes whose key lies in no protected file range.

    ``protected`` has smallest_key and largest_key of the files outside a merge. A few
    ranges make an expression. With more of them, deletes and ranges are put in one
    order: a key is protected if the largest end of all ranges that begin up to it is
    not below it, whether they overlap or not. Puts pass untouched.
    """
    ranges = protected.select("smallest_key", "largest_key").where(
        F.col("smallest_key").isNotNull() & F.col("largest_key").isNotNull()
    )
    few = ranges.limit(_FEW_RANGES + 1).collect()
    if len(few) <= _FEW_RANGES:
        covered = F.lit(False)
        for lo, hi in few:
            covered = covered | F.col("key").between(F.lit(bytes(lo)), F.lit(bytes(hi)))
        return merged.where((F.col("op") == PUT) | covered)
    deletes = merged.where(F.col("op") == DELETE)
    starts = ranges.groupBy(F.col("smallest_key").alias("key")).agg(F.max("largest_key").alias("_end"))
    both = stacked(
        starts.select("key", "_end", F.lit(0).alias("_kind")),
        # of a key there is one version in an image
        deletes.select("key", F.lit(None).cast("binary").alias("_end"), F.lit(1).alias("_kind")),
    )
    order = ["key", "_kind"]
    reached = running(in_ranges(both, *order), order, "_reach", F.col("_end"), "max")
    kept = reached.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("key"))).select("key")
    return stacked(merged.where(F.col("op") == PUT), deletes.join(kept, "key", "left_semi").select(*merged.columns))


def compact(tables: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Merge of files: holding versions, without deletes that protect nothing."""
    merged = latest(tables, keep_deletes=True)
    return merged if protected is None else reclaim_deletes(merged, protected)


def overlaps(ranges: DataFrame) -> DataFrame:
    """(file_id, n_overlapping, group_id) of files with smallest_key and largest_key.

    ``n_overlapping`` is the number of other files whose range meets the file's own:
    those that begin up to its end, less those that end before its beginning.
    ``group_id`` counts, in key order from 1, the groups of files that overlap directly
    or through one another. No pair is ever listed. Files without range have no row.
    """
    files = ranges.select("file_id", "smallest_key", "largest_key").where(
        F.col("smallest_key").isNotNull() & F.col("largest_key").isNotNull()
    )
    # what happens along the keys: 0 a file begins, 1 one ends; a beginning goes first
    events = files.select(
        "file_id",
        F.explode(
            F.array(
                F.struct(F.col("smallest_key").alias("key"), F.lit(0).alias("end")),
                F.struct(F.col("largest_key").alias("key"), F.lit(1).alias("end")),
            )
        ).alias("e"),
    ).select("file_id", "e.key", "e.end")
    order = ["key", "end", "file_id"]
    placed = running(in_ranges(events, *order), order, "begun", 1 - F.col("end"))
    placed = running(placed, order, "ended", F.col("end"))
    # a group begins where as many have ended before as have begun
    fresh = (F.col("end") == 0) & (F.col("begun") - 1 == F.col("ended"))
    placed = running(placed, order, "group_id", F.when(fresh, 1))
    return placed.groupBy("file_id").agg(
        # begun at an end: all that begin up to it; ended at a beginning: all that end before it
        (
            F.max(F.when(F.col("end") == 1, F.col("begun"))) - F.max(F.when(F.col("end") == 0, F.col("ended"))) - 1
        ).alias("n_overlapping"),
        F.max(F.when(F.col("end") == 0, F.col("group_id"))).alias("group_id"),
    )


def closure(files: list[dict], seeds: set[int]) -> set[int]:
    """File ids that overlap the seeds, directly or through one another.

    ``files`` are entries of a manifest with file_id, lo and hi; one sweep in key order.
    """
    chosen: set[int] = set()
    group: list[int] = []
    end = None
    for f in sorted(files, key=lambda f: f["lo"]):
        if end is not None and f["lo"] > end:
            chosen.update(group if seeds & set(group) else ())
            group, end = [], None
        group.append(f["file_id"])
        end = f["hi"] if end is None else max(end, f["hi"])
    chosen.update(group if seeds & set(group) else ())
    return chosen | seeds


def cut_by_bytes(image: DataFrame, target: int) -> DataFrame:
    """``image`` with ``part``: key-ordered parts of about ``target`` bytes each.

    The part of a row is the number of whole targets in the bytes of all keys before
    it. ``image`` has one version per key; every row comes out once.
    """
    if target < 1:
        raise InvalidInput("the target must be at least one byte")
    sized = image.withColumn("_size", frame_bytes(F.col("key"), F.col("value")).cast("long"))
    upto = running(in_ranges(sized, "key"), ["key"], "_upto", F.col("_size"))
    part = F.floor((F.col("_upto") - F.col("_size")) / target).cast("long")
    return upto.withColumn("part", part).drop("_size", "_upto", RANGE)


def cut_in_place(image: DataFrame, target: int, ranges: int) -> DataFrame:
    """(key, lsn, op, value, range, part): files of at most ``target`` bytes, in one pass.

    The image is spread over key ranges, one task each, and every task begins a new
    part where the next version would go beyond the target; a version larger than
    that is a part of its own. Rows come sorted by range, part and key.
    """
    if target < 1:
        raise InvalidInput("the target must be at least one byte")
    chosen = image.select("key", "lsn", "op", "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = pc.add(
                pc.binary_length(batch.column("key")), pc.fill_null(pc.binary_length(batch.column("value")), 0)
            )
            upto = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64) + FRAME)
            parts, at, done = np.empty(n, np.int64), 0, 0
            while at < n:  # once a part, not once a row
                end = int(np.searchsorted(upto, done + target - held, "right"))
                if end <= at:
                    if held:
                        part, held = part + 1, 0
                        continue
                    end = at + 1  # too large for any part
                parts[at:end] = part
                held, at, done = held + int(upto[end - 1]) - done, end, int(upto[end - 1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(parts)],
                ["key", "lsn", "op", "value", "range", "part"],
            )

    kind = "key binary, lsn bigint, op tinyint, value binary, range int, part bigint"
    ordered = chosen.withColumn("op", F.col("op").cast("byte")).repartitionByRange(ranges, "key")
    numbered = ordered.sortWithinPartitions("key").mapInArrow(number, kind)
    return numbered.sortWithinPartitions("range", "part", "key")


def statistics(changes: DataFrame) -> DataFrame:
    """One row: number of rows and keys, bytes, and the highest lsn."""
    return changes.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("key").alias("n_keys"),
        F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0))
        .cast("long").alias("n_bytes"),
        F.coalesce(F.max("lsn"), F.lit(0)).alias("max_lsn"),
    )


def clean_statistics(changes: DataFrame) -> DataFrame:
    """One row on what a full rewrite keeps: live rows, their bytes, value bytes, highest lsn."""
    live = latest(changes)
    return live.agg(
        F.count("*").alias("live_rows"),
        F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0))
        .cast("long").alias("live_bytes"),
        F.coalesce(F.sum(F.length("value")), F.lit(0)).cast("long").alias("value_bytes"),
        F.coalesce(F.max("lsn"), F.lit(0)).alias("max_lsn"),
    )


def level_statistics(tables: DataFrame) -> DataFrame:
    """(level, n_files, n_rows, n_bytes) of each level."""
    return tables.groupBy("level").agg(
        F.countDistinct("file_id").alias("n_files"),
        F.count("*").alias("n_rows"),
        F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).cast("long").alias("n_bytes"),
    )


def bad_checksums(changes: DataFrame) -> DataFrame:
    """Rows whose value does not have the CRC32 that was written with it."""
    return changes.where(F.col("value").isNotNull() & (F.crc32("value") != F.col("checksum")))


def resolve_references(index: DataFrame, values: DataFrame) -> DataFrame:
    """Index rows (key, ref) with the values of a value table (ref, value, checksum).

    A reference without value or with a wrong checksum gives a row with ok = false.
    """
    joined = index.join(values.select("ref", "value", "checksum"), "ref", "left")
    good = F.coalesce(F.crc32("value") == F.col("checksum"), F.lit(False))
    return joined.select("key", F.when(good, F.col("value")).alias("value"), good.alias("ok"))

"""Whether a key has been seen before: perfect hashes over sealed partitions.

Records are taken in batches of consecutive record ids. Within the current batch
keys are compared exactly. The distinct keys of an ended batch are sealed: a
minimal perfect hash gives each of them a slot of its own in some 4 bits a key, and
an array holds at each slot a short fingerprint and the batch. A later key is looked
up at its computed slot; if the fingerprint there differs, the key is new for
certain, since a sealed key always meets its own. An equal fingerprint is a claim,
wrong with a probability of about 2^-bits, and claims are checked: the rate of wrong
ones is measured, not assumed. Sealed partitions of similar size are merged, so a
key is looked up in a number of them that grows with the logarithm of the batches.

Keys are spread over buckets by hash, a task for each, and a bucket holds each key at
most once per batch, so a key in a third of all records is no hotter than any other.
The Python side sees two 64-bit hashes, never the keys. Whether two different keys
share both hashes is looked for within the buckets; such keys are decided by their bytes.

``SealedKeys`` keeps the sealed partitions of a bucket in a table, for records that
come later: they are answered from perfect hashes and fingerprints alone.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.errors import InvalidInput
from siltstone.sources.shared import PublishedTable, checkpointed, stacked

#: The batch of keys that stood in sealed files before the first record.
FILES = -1
#: Least record ids of a batch, and how many batches the ids may make: with few, most
#: earlier keys would stand in the batch itself, with many each would be a few keys a bucket.
LEAST_BATCH, MAX_BATCHES = 1 << 14, 128
#: Slots per remaining key on each level of the perfect hash.
GAMMA = 2.0
_MAX_LEVELS = 48


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash per key and level."""
    with np.errstate(over="ignore"):
        x = h1 + h2 * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


class PerfectHash:
    """Slots 0..n-1 for n distinct hash pairs; other pairs get any slot or -1."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        left1, left2, used = h1, h2, 0
        for level in range(_MAX_LEVELS):
            if not len(left1):
                break
            m = max(64, int(GAMMA * len(left1)) + 63 & ~63)
            at = (_mixed(left1, left2, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(alone, bitorder="little")
            ranks = np.zeros(m // 64 + 1, np.int64)
            np.cumsum(alone.reshape(-1, 64).sum(axis=1), out=ranks[1:])
            self.levels.append((m, bits, ranks[:-1].astype(np.uint32), used))
            used += int(ranks[-1])
            collided = ~alone[at]
            left1, left2 = left1[collided], left2[collided]
        order = np.lexsort((left2, left1))
        self.rest = left1[order], left2[order]
        self.used = used

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        for level, (m, bits, ranks, used) in enumerate(self.levels):
            if not len(open_):
                return out
            at = (_mixed(h1[open_], h2[open_], level) % np.uint64(m)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            place = at[hit]
            words = bits.view(np.uint64)[place >> 6]
            below = words & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = used + ranks[place >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        for k, (a, b) in enumerate(zip(*self.rest)):  # as a rule none
            out[open_[(h1[open_] == a) & (h2[open_] == b)]] = self.used + k
        return out

    def nbytes(self) -> int:
        return sum(b.nbytes + r.nbytes for _, b, r, _ in self.levels) + 16 * len(self.rest[0])


def _fingerprints(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
    return (_mixed(h2, h1, 97) >> np.uint64(64 - bits)).astype(kind)


class Sealed:
    """One sealed partition; ``at`` are its rows in the log of hashes."""

    def __init__(self, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, batch: np.ndarray, bits: int):
        self.at, self.bits = at, bits
        self.hash = PerfectHash(h1[at], h2[at])
        slots = self.hash.slots(h1[at], h2[at])
        self.prints = np.zeros(len(at), _fingerprints(h1[:0], h2[:0], bits).dtype)
        self.prints[slots] = _fingerprints(h1[at], h2[at], bits)
        self.batches = np.zeros(len(at), np.int32)
        self.batches[slots] = batch[at]
        self.rows = np.zeros(len(at), np.int64)
        self.rows[slots] = at

    def nbytes(self) -> int:
        """Bytes of all that is kept by slot."""
        return self.hash.nbytes() + self.prints.nbytes + self.batches.nbytes + self.rows.nbytes

    def claims(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs meet an equal fingerprint, and at which slot."""
        slots = self.hash.slots(h1, h2)
        who = np.flatnonzero(slots >= 0)
        who = who[self.prints[slots[who]] == _fingerprints(h1[who], h2[who], self.bits)]
        return who, slots[who]


def _distinct(at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Rows ``at`` without those whose hash pair an earlier one of them has."""
    order = np.lexsort((at, h2[at], h1[at]))
    s = at[order]
    first = np.concatenate(([True], (h1[s[1:]] != h1[s[:-1]]) | (h2[s[1:]] != h2[s[:-1]])))
    return s[first]


LOOKED_UP = (
    "batch int, record_id long, h1 long, h2 long, shared boolean, claimed int, lookups int, wrong int, "
    "sealed_keys long, sealed_bytes long"
)


def _bucket_lookup(bits: int):
    """Looks up a bucket's batches one after another, sealing each when it has ended.

    Of each row of a batch: the batch of the sealed key that it equals by all 128
    bits of hash, or null; the number of partitions asked; the number of claims that
    those 128 bits refuted.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("batch", "ascending"), ("record_id", "ascending")])
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        batch = table.column("batch").to_numpy()
        n = len(batch)
        claimed = np.full(n, np.iinfo(np.int32).min, np.int32)
        lookups, wrong = np.zeros(n, np.int32), np.zeros(n, np.int32)
        sealed: list[Sealed] = []
        starts = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1])))
        for lo, hi in zip(starts, np.append(starts[1:], n)):
            mine = np.arange(lo, hi)
            if batch[lo] != FILES:
                for part in sealed:
                    lookups[lo:hi] += 1
                    who, slots = part.claims(h1[lo:hi], h2[lo:hi])
                    rows = part.rows[slots]
                    same = (h1[rows] == h1[lo + who]) & (h2[rows] == h2[lo + who])
                    wrong[lo + who[~same]] += 1
                    claimed[lo + who[same]] = part.batches[slots[same]]
            fresh = mine[claimed[lo:hi] == np.iinfo(np.int32).min]
            if not len(fresh):
                continue
            at = _distinct(fresh, h1, h2)
            while sealed and len(sealed[-1].at) < 2 * len(at):
                at = np.concatenate([sealed.pop().at, at])
            sealed.append(Sealed(at, h1, h2, batch, bits))
        # also what claims are refuted by: both hashes of every batch key
        size = sum(s.nbytes() for s in sealed) + h1.nbytes + h2.nbytes
        held, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        shown = np.flatnonzero(batch != FILES)[-1:]
        held[shown], sizes[shown] = sum(len(s.at) for s in sealed), size
        claimed = pa.array(claimed, mask=claimed == np.iinfo(np.int32).min)
        none = pa.scalar(None, pa.int64())  # only hashes that different keys share are asked for again
        few = [pc.if_else(table.column("shared"), table.column(c), none) for c in ("h1", "h2")]
        out = pa.table(
            [*(table.column(c) for c in ("batch", "record_id")), *few, table.column("shared"), claimed,
             pa.array(lookups), pa.array(wrong), pa.array(held), pa.array(sizes)],
            names=["batch", "record_id", "h1", "h2", "shared", "claimed", "lookups", "wrong", "sealed_keys", "sealed_bytes"],
        )
        return out.filter(pc.not_equal(out.column("batch"), FILES))

    return run


def batch_keys(records: DataFrame, files: DataFrame, batch_rows: int) -> DataFrame:
    """(key, batch, record_id): each batch's distinct keys with their first record id.

    Keys of sealed files have batch -1 and no record id. Null keys are left out.
    """
    batch = F.floor(F.col("record_id") / F.lit(batch_rows)).cast("int")
    own = (
        records.where(F.col("key").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("key", batch.alias("batch"))
        .agg(F.min("record_id").alias("record_id"))
    )
    sealed = (
        files.where(F.col("key").isNotNull())
        .select("key")
        .distinct()
        .select("key", F.lit(FILES).alias("batch"), F.lit(None).cast("long").alias("record_id"))
    )
    return stacked(own, sealed)


def batch_size(records: DataFrame) -> int:
    """Record ids of a batch: a power of two times LEAST_BATCH, for at most MAX_BATCHES of them."""
    ids = records.agg(F.min("record_id"), F.max("record_id")).first()
    size = LEAST_BATCH
    if ids[0] is not None:
        while ids[1] // size - ids[0] // size >= MAX_BATCHES:
            size *= 2
    return size


def lookup(
    records: DataFrame,
    files: DataFrame,
    *,
    batch_rows: int | None = None,
    bucket_rows: int = 150_000,
    fingerprint_bits: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """The looked-up first rows of every batch (LOOKED_UP) and the batches' keys.

    Without ``batch_rows`` batches are of ``batch_size``. There are buckets for all rows,
    should all their keys differ. The keys are moved once, to their buckets, where their
    bytes are compared and their hashes looked up.
    """
    if batch_rows is None:
        batch_rows = batch_size(records)
    buckets = max(8, -(-(records.count() + files.count()) // bucket_rows))
    keys = batch_keys(records, files, batch_rows).select("key", "batch", "record_id", *_hashes(buckets))
    same = W.partitionBy("bucket", "h1", "h2")
    shared = F.min("key").over(same) != F.max("key").over(same)
    placed = keys.repartition(buckets, "bucket").select("bucket", "batch", "record_id", "h1", "h2", shared.alias("shared"))
    looked = placed.groupBy("bucket").applyInArrow(_bucket_lookup(fingerprint_bits), LOOKED_UP)
    return checkpointed(looked), keys


def _hashes(buckets: int) -> list[Column]:
    """Both hashes of a key and its bucket."""
    h1, h2 = F.xxhash64("key"), F.xxhash64(F.lit(7), "key")
    return [h1.alias("h1"), h2.alias("h2"), F.pmod(F.hash(h2), F.lit(buckets)).alias("bucket")]


def new_keys(looked: DataFrame, keys: DataFrame) -> DataFrame:
    """Record ids of the rows at which a key stands for the first time.

    A lookup decides by 128 bits of hash. Hashes that different keys share, which there
    are none of as a rule, are marked in their buckets; their keys are decided by all
    batches that they stand in.
    """
    new = looked.where(F.col("claimed").isNull())
    twice = looked.where("shared").select("h1", "h2").distinct()
    if not twice.limit(1).count():
        return new.select("record_id")
    # a key of the files has a null id in batch -1, before all others
    first = F.min(F.struct("batch", "record_id"))["record_id"].alias("record_id")
    decided = keys.join(twice, ["h1", "h2"], "left_semi").groupBy("key").agg(first).select("record_id")
    return stacked(new.where(~F.col("shared")).select("record_id"), decided.where(F.col("record_id").isNotNull()))


def seen_before(records: DataFrame, files: DataFrame, **settings) -> DataFrame:
    """Record ids of rows whose key stood in ``files`` or in a row with a smaller id.

    ``records`` needs key and a unique record_id, ``files`` a key; other columns are
    ignored. The empty key is a key; rows with null key or null id never appear.
    Empty tables are fine.
    """
    new = new_keys(*lookup(records, files, **settings))
    rows = records.where(F.col("key").isNotNull() & F.col("record_id").isNotNull())
    return rows.select("record_id").join(new, "record_id", "left_anti")


def wrong_rate(records: DataFrame, files: DataFrame, **settings) -> DataFrame:
    """One row: keys looked up, lookups in sealed partitions, wrong claims and their share.

    Also the sealed keys and all bytes kept for them, of buckets in which a key was
    looked up: perfect hash, fingerprint, batch and row of every slot, and the two
    hashes of every batch key that claims are compared with.
    """
    looked, _ = lookup(records, files, **settings)
    return looked.agg(
        F.count("*").alias("batch_keys"),
        F.coalesce(F.sum(F.col("lookups").cast("long")), F.lit(0)).alias("lookups"),
        F.coalesce(F.sum(F.col("wrong").cast("long")), F.lit(0)).alias("wrong_claims"),
        F.coalesce(F.sum("sealed_keys"), F.lit(0)).alias("sealed_keys"),
        F.coalesce(F.sum("sealed_bytes"), F.lit(0)).alias("sealed_bytes"),
    ).withColumn(
        "bytes_per_key",
        F.when(F.col("sealed_keys") > 0, F.col("sealed_bytes") / F.col("sealed_keys")).otherwise(0.0),
    ).withColumn(
        "wrong_share",
        F.when(F.col("lookups") > 0, F.col("wrong_claims") / F.col("lookups")).otherwise(0.0),
    )


class SealedKeys:
    """Sealed partitions that outlive a run, in a table of the shared folder.

    A row is a sealed partition of a bucket: its perfect hash with the fingerprints, and
    apart from that the hashes of its keys, which only ``merge`` reads. A lookup is wrong
    with a probability of 2^-bits for each partition asked, and only by taking a new key
    for a known one; which those were can be told from ``records`` alone while they are
    there, see ``wrong_rate``.
    """

    def __init__(self, spark: SparkSession, folder: str, *, bits: int = 32, expected_keys: int = 0):
        if not 1 <= bits <= 32:
            raise InvalidInput("a fingerprint has 1 to 32 bits")
        self.table = PublishedTable(spark, folder)
        self.spark = spark
        now = self.table.current()
        if now is None:
            now = {"bits": bits, "buckets": max(8, -(-expected_keys // 1_000_000))}
            empty = spark.createDataFrame([], "bucket int, n long, body binary, hashes binary")
            self.table.publish(empty, **now)
        self.bits, self.buckets = now["bits"], now["buckets"]

    def add(self, records: DataFrame) -> DataFrame:
        """Record ids of rows whose key an earlier call or a row with a smaller id had.

        Within the call keys are compared exactly, with those of earlier calls by
        fingerprint. The new keys are sealed and published; a call that fails seals
        nothing. Rows with null key or id are left out.
        """
        rows = records.where(F.col("key").isNotNull() & F.col("record_id").isNotNull())
        firsts = rows.groupBy("key").agg(F.min("record_id").alias("record_id"))
        hashed = firsts.select("record_id", *_hashes(self.buckets))
        before = self.table.current()["generation"]
        known = self.table.read().select("bucket", "n", "body")
        answered = checkpointed(
            hashed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
                _answer_and_seal(self.bits), "record_id long, seen boolean, bucket int, n long, body binary, hashes binary"
            )
        )
        fresh = answered.where(F.col("body").isNotNull()).select("bucket", "n", "body", "hashes")
        self._publish(stacked(self.table.read(), fresh), before)
        new = answered.where(F.col("seen") == F.lit(False)).select("record_id")
        return rows.select("record_id").join(new, "record_id", "left_anti")

    def merge(self) -> None:
        """Make one partition of each bucket's, so that a key is looked up once."""
        before = self.table.current()["generation"]
        merged = self.table.read().groupBy("bucket").applyInArrow(
            _merge_sealed(self.bits), "bucket int, n long, body binary, hashes binary"
        )
        self._publish(merged, before)

    def _publish(self, rows: DataFrame, expected: str) -> None:
        self.table.publish(rows, expected=expected, bits=self.bits, buckets=self.buckets)


def _packed(part: Sealed) -> bytes:
    """The perfect hash and fingerprints of a sealed partition as bytes."""
    arrays = {"prints": part.prints, "rest1": part.hash.rest[0], "rest2": part.hash.rest[1]}
    for i, (m, bits, ranks, used) in enumerate(part.hash.levels):
        arrays |= {f"bits{i}": bits, f"ranks{i}": ranks, f"head{i}": np.array([m, used], np.int64)}
    out = io.BytesIO()
    np.savez(out, used=np.array(part.hash.used), **arrays)
    return out.getvalue()


def _unpacked(body: bytes, bits: int) -> Sealed:
    """A partition that can be asked; it knows neither its keys nor their batches."""
    held = np.load(io.BytesIO(body))
    part, part.hash = Sealed.__new__(Sealed), PerfectHash.__new__(PerfectHash)
    part.bits, part.prints = bits, held["prints"]
    part.hash.rest, part.hash.used = (held["rest1"], held["rest2"]), int(held["used"])
    part.hash.levels = []
    while f"bits{len(part.hash.levels)}" in held:
        i = len(part.hash.levels)
        m, used = held[f"head{i}"].tolist()
        part.hash.levels.append((m, held[f"bits{i}"], held[f"ranks{i}"], used))
    return part


def _sealed_row(bucket: int, h1: np.ndarray, h2: np.ndarray, fresh: np.ndarray, bits: int) -> dict:
    """A partition of the fresh keys, with the hashes of all: what a claim answered, rightly or
    not, is a key all the same and must be known after a merge."""
    at = _distinct(np.arange(len(h1)), h1, h2)
    own = at[fresh[at]]
    part = Sealed(own, h1, h2, np.zeros(len(h1), np.int32), bits)
    return {"bucket": bucket, "n": len(own), "body": _packed(part), "hashes": np.stack([h1[at], h2[at]]).tobytes()}


_SEALED = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("body", pa.binary()), ("hashes", pa.binary())])


def _answer_and_seal(bits: int):
    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        h1, h2 = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        seen = np.zeros(len(h1), bool)
        for body in known.column("body"):
            who, _ = _unpacked(body.as_py(), bits).claims(h1, h2)
            seen[who] = True
        answers = pa.table({"record_id": asked.column("record_id"), "seen": pa.array(seen)})
        sealed = [_sealed_row(asked.column("bucket")[0].as_py(), h1, h2, ~seen, bits)] if len(h1) else []
        out = pa.concat_tables([answers, pa.Table.from_pylist(sealed, _SEALED)], promote_options="default")
        return out.select(["record_id", "seen", *_SEALED.names])

    return run


def _merge_sealed(bits: int):
    def run(parts: pa.Table) -> pa.Table:
        held = [np.frombuffer(h.as_py(), np.uint64).reshape(2, -1) for h in parts.column("hashes")]
        h1, h2 = np.concatenate(held, axis=1)
        every = np.ones(len(h1), bool)
        return pa.Table.from_pylist([_sealed_row(parts.column("bucket")[0].as_py(), h1, h2, every, bits)], _SEALED)

    return run

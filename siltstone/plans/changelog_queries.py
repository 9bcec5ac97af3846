"""Key-value queries over wal_records, level_records and manifest.

The change log is wal_records with record_type as op; the sealed files are
level_records. Keys come out in hexadecimal and values as their md5, so that both
engines compare the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.functions.bytes import bloom_contains
from siltstone.operators import changelog as cl
from siltstone.operators.changelog import Bound
from siltstone.sources.shared import read_table, stacked

#: A sequence number in the middle of the log, and key bounds that split the keys.
AS_OF = 1_010_000
#: A sequence number at which the hottest key is live.
EARLY = 1_001_000
#: Both bounds are live keys of the tables at every scale, so that it shows whether they are included.
LOW, HIGH, PREFIX = b"acct/d062c40a81/bal", b"caf\xc3\xa9/f1e4c0e999", b"sess:"
#: The hottest key, one that is live at the end of the log and one that was put and deleted.
HOT, LIVE, DEAD = b"lease/leader", b"doc0056208512005", b"doc0005774232546"
#: Keys whose rows some queries tamper with, to see that the damage is found.
TAMPERED, LOST = b"acct/", b"sess:"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_table(spark, sf_dir, "wal_records")
        .withColumnRenamed("record_type", "op")
        .select("key", "lsn", "op", "value", "txn_id", "checksum", "segment_id", "arrival_no", "pos")
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "level_records")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.hex("key").alias("key_hex"), F.md5("value").alias("value_md5"))


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.hex("key").alias("key_hex"), "lsn", F.col("op").cast("int").alias("op"),
        F.md5("value").alias("value_md5"),
    )


_LATEST = """
with log as (select key, lsn, record_type as op, value, txn_id from wal_records),
held as (
    select * from {source}
    where key is not null and lsn is not null {where}
    qualify row_number() over (partition by key order by lsn desc, op desc, value desc nulls last) = 1
)
"""
_PAIRS = "select hex(key) as key_hex, md5(value) as value_md5 from held where op = 1"
_VERSIONS = "select hex(key) as key_hex, lsn, op::int as op, md5(value) as value_md5 from held"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return register


def _latest_sql(where: str = "", source: str = "log", out: str = _PAIRS) -> str:
    return _LATEST.format(source=source, where=where) + out


def _blob(b: bytes) -> str:
    return f"unhex('{b.hex()}')"


@_query("kv_scan_live", _latest_sql())
def kv_scan_live(spark, sf_dir):
    return _pairs(cl.scan(_log(spark, sf_dir)))


@_query("kv_scan_asof", _latest_sql(f"and lsn <= {AS_OF}"))
def kv_scan_asof(spark, sf_dir):
    return _pairs(cl.scan(_log(spark, sf_dir), lsn=AS_OF))


@_query("kv_get_point", _latest_sql(f"and key = {_blob(LIVE)}"))
def kv_get_point(spark, sf_dir):
    return _pairs(cl.point_get(_log(spark, sf_dir), LIVE))


@_query("kv_get_point_asof", _latest_sql(f"and lsn <= {EARLY} and key = {_blob(HOT)}"))
def kv_get_point_asof(spark, sf_dir):
    return _pairs(cl.point_get(_log(spark, sf_dir), HOT, lsn=EARLY))


@_query(
    "kv_get_deleted",
    f"""
select hex({_blob(DEAD)}) as key_hex, count(*) filter (where record_type = 1) as n_puts,
    count(*) filter (where record_type = 2) as n_deletes, 0::bigint as n_found
from wal_records where key = {_blob(DEAD)}
""",
)
def kv_get_deleted(spark, sf_dir):
    """A key that was put and deleted: how often, and that a read of the whole log finds nothing."""
    log = _log(spark, sf_dir)
    counts = log.where(F.col("key") == F.lit(DEAD)).agg(
        F.count(F.when(F.col("op") == 1, 1)).alias("n_puts"), F.count(F.when(F.col("op") == 2, 1)).alias("n_deletes")
    )
    found = cl.point_get(log, DEAD).agg(F.count("*").alias("n_found"))
    return counts.crossJoin(found).select(F.lit(DEAD.hex().upper()).alias("key_hex"), "*")  # a row each


def _range_query(name: str, low: Bound, high: Bound, where: str) -> None:
    @_query(name, _latest_sql(where))
    def run(spark, sf_dir):
        return _pairs(cl.scan(_log(spark, sf_dir), low, high))


_lo, _hi = _blob(LOW), _blob(HIGH)
_range_query("kv_scan_range_ii", Bound(LOW), Bound(HIGH), f"and key >= {_lo} and key <= {_hi}")
_range_query("kv_scan_range_ie", Bound(LOW), Bound(HIGH, False), f"and key >= {_lo} and key < {_hi}")
_range_query("kv_scan_range_ei", Bound(LOW, False), Bound(HIGH), f"and key > {_lo} and key <= {_hi}")
_range_query("kv_scan_range_ee", Bound(LOW, False), Bound(HIGH, False), f"and key > {_lo} and key < {_hi}")
_range_query("kv_scan_from", Bound(LOW), Bound(), f"and key >= {_lo}")
_range_query("kv_scan_to", Bound(), Bound(HIGH, False), f"and key < {_hi}")
_range_query("kv_scan_range_empty", Bound(HIGH), Bound(LOW), "and false")


@_query("kv_scan_prefix", _latest_sql(f"and hex(key) like '{PREFIX.hex().upper()}%'"))
def kv_scan_prefix(spark, sf_dir):
    return _pairs(cl.prefix_scan(_log(spark, sf_dir), PREFIX))


@_query("kv_outside_namespace", _latest_sql(f"and hex(key) not like '{PREFIX.hex().upper()}%'"))
def kv_outside_namespace(spark, sf_dir):
    return _pairs(cl.scan(cl.outside_namespace(_log(spark, sf_dir), PREFIX)))


@_query(
    "kv_tie_delete_wins",
    "select hex(key) as key_hex, lsn, 2 as op from wal_records where key is not null and lsn is not null "
    "qualify row_number() over (partition by key order by lsn desc) = 1",
)
def kv_tie_delete_wins(spark, sf_dir):
    """Every change is followed by a delete of equal lsn: the delete holds for every key."""
    log = _log(spark, sf_dir)
    deletes = log.withColumn("op", F.lit(2).cast("byte")).withColumn("value", F.lit(None).cast("binary"))
    return cl.flush_image(stacked(log, deletes)).select(
        F.hex("key").alias("key_hex"), "lsn", F.col("op").cast("int").alias("op")
    )


@_query(
    "kv_batch_last_op_wins",
    """
with ops as (
    select key, record_type as op, value, segment_id as batch_id,
        row_number() over (partition by segment_id order by arrival_no) - 1 as pos
    from wal_records where key is not null
), held as (
    select * from ops qualify row_number() over (partition by key order by batch_id desc, pos desc) = 1
) """
    + _PAIRS,
)
def kv_batch_last_op_wins(spark, sf_dir):
    """Segments taken as batches in order of arrival: the last operation on a key holds."""
    place = F.row_number().over(W.partitionBy("segment_id").orderBy("arrival_no")) - 1
    batches = (
        _log(spark, sf_dir)
        .where(F.col("key").isNotNull())
        .select("key", "op", "value", F.col("segment_id").alias("batch_id"), place.alias("pos"))
    )
    return _pairs(cl.latest(cl.batch_to_changes(batches)))


@_query(
    "kv_committed_only",
    """
select hex(key) as key_hex, lsn, record_type::int as op, md5(value) as value_md5 from wal_records
where txn_id is null or txn_id in (select txn_id from wal_commits where txn_id is not null)
""",
)
def kv_committed_only(spark, sf_dir):
    return _versions(cl.committed_only(_log(spark, sf_dir), read_table(spark, sf_dir, "wal_commits")))


@_query(
    "kv_replay_positions",
    """
select segment_id, lsn, pos, arrival_no, record_type::int as op,
    row_number() over (partition by segment_id order by lsn, pos nulls first, arrival_no) as place
from wal_records
where txn_id is null or txn_id in (select txn_id from wal_commits where txn_id is not null)
""",
)
def kv_replay_positions(spark, sf_dir):
    """Committed changes with their place in the replay of each segment."""
    done = cl.committed_only(_log(spark, sf_dir), read_table(spark, sf_dir, "wal_commits"))
    order = W.partitionBy("segment_id").orderBy("lsn", F.asc_nulls_first("pos"), "arrival_no")
    return done.select(
        "segment_id", "lsn", "pos", "arrival_no", F.col("op").cast("int").alias("op"),
        F.row_number().over(order).cast("long").alias("place"),
    )


@_query("kv_flush_image", _latest_sql(out=_VERSIONS))
def kv_flush_image(spark, sf_dir):
    return _versions(cl.flush_image(_log(spark, sf_dir)))


def _begins(prefix: bytes) -> Column:
    return F.hex("key").startswith(prefix.hex().upper())


def _sql_begins(prefix: bytes) -> str:
    return f"hex(key) like '{prefix.hex().upper()}%'"


@_query(
    "kv_flush_gaps",
    _latest_sql(out=f"select hex(key) as key_hex, lsn, op::int as op from held where {_sql_begins(LOST)} or {_sql_begins(TAMPERED)}"),
)
def kv_flush_gaps(spark, sf_dir):
    """A flush image that lacks some keys and holds other values for some: all of them are gaps."""
    log = _log(spark, sf_dir)
    image = cl.flush_image(log).where(~_begins(LOST))
    altered = F.concat(F.coalesce("value", F.lit(b"")), F.lit(b"!"))
    image = image.withColumn("value", F.when(_begins(TAMPERED), altered).otherwise(F.col("value")))
    return cl.coverage_gaps(log, image).select(
        F.hex("key").alias("key_hex"), "lsn", F.col("op").cast("int").alias("op")
    )


@_query("kv_compact_merge", _latest_sql(source="level_records", out=_VERSIONS))
def kv_compact_merge(spark, sf_dir):
    return _versions(cl.compact(_files(spark, sf_dir)))


@_query("kv_compact_scan_equiv", _latest_sql(source="level_records"))
def kv_compact_scan_equiv(spark, sf_dir):
    """A scan after compaction gives what a scan before gives."""
    return _pairs(cl.latest(cl.compact(_files(spark, sf_dir))))


@_query(
    "kv_tombstone_reclaim",
    """
with ranges as (
    select min(key) as lo, max(key) as hi from level_records where level >= 2 group by file_id
), held as (
    select * from level_records where level < 2 and key is not null and lsn is not null
    qualify row_number() over (partition by key order by lsn desc, op desc, value desc nulls last) = 1
)
select hex(key) as key_hex, lsn, op::int as op, md5(value) as value_md5 from held
where op = 1 or exists (select 1 from ranges where held.key between lo and hi)
""",
)
def kv_tombstone_reclaim(spark, sf_dir):
    """Merge of levels 0 and 1; deletes stay only within ranges of deeper files."""
    files = _files(spark, sf_dir)
    deeper = cl.key_ranges(files.where("level >= 2"))
    return _versions(cl.compact(files.where("level < 2"), deeper))


@_query(
    "kv_overlaps",
    """
with r as (select file_id, min(key) as lo, max(key) as hi from level_records group by file_id),
n as (
    select a.file_id, count(b.file_id) as n_overlapping from r a left join r b
    on a.file_id <> b.file_id and a.lo <= b.hi and b.lo <= a.hi group by a.file_id
), s as (
    select *, max(hi) over (order by lo, file_id rows between unbounded preceding and 1 preceding) as reach from r
), g as (
    select file_id, sum(case when reach is null or reach < lo then 1 else 0 end)
        over (order by lo, file_id rows unbounded preceding)::bigint as group_id from s
)
select * from n join g using (file_id)
""",
)
def kv_overlaps(spark, sf_dir):
    """How many files each overlaps, and the group that it overlaps through one another."""
    return cl.overlaps(cl.key_ranges(_files(spark, sf_dir)))


@_query(
    "kv_partition_bytes",
    _latest_sql(
        source="level_records",
        out="""
, sized as (select key, 62 + octet_length(key) + coalesce(octet_length(value), 0) as size from held),
placed as (select *, sum(size) over (order by key rows unbounded preceding) - size as before from sized)
select (before // 16384)::bigint as part, count(*) as n_rows, sum(size)::bigint as n_bytes from placed group by 1
""",
    ),
)
def kv_partition_bytes(spark, sf_dir):
    parts = cl.cut_by_bytes(cl.compact(_files(spark, sf_dir)), 16_384)
    size = F.lit(62) + F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    return parts.groupBy("part").agg(
        F.count("*").alias("n_rows"), F.sum(size).cast("long").alias("n_bytes")
    )


@_query(
    "kv_stats",
    """
select count(*) as n_rows, count(distinct key) as n_keys,
    sum(octet_length(key) + coalesce(octet_length(value), 0))::bigint as n_bytes, max(lsn) as max_lsn
from wal_records
""",
)
def kv_stats(spark, sf_dir):
    return cl.statistics(_log(spark, sf_dir))


@_query(
    "kv_level_bytes",
    """
select level, count(distinct file_id) as n_files, count(*) as n_rows,
    sum(octet_length(key) + coalesce(octet_length(value), 0))::bigint as n_bytes
from level_records group by level
""",
)
def kv_level_bytes(spark, sf_dir):
    return cl.level_statistics(_files(spark, sf_dir))


@_query(
    "kv_clean_stats",
    _latest_sql(
        out="""
select count(*) as live_rows, sum(octet_length(key) + coalesce(octet_length(value), 0))::bigint as live_bytes,
    sum(octet_length(value))::bigint as value_bytes, max(lsn) as max_lsn from held where op = 1
"""
    ),
)
def kv_clean_stats(spark, sf_dir):
    return cl.clean_statistics(_log(spark, sf_dir))


@_query(
    "kv_key_range",
    """
select file_id, hex(min(key)) as smallest_hex, hex(max(key)) as largest_hex, count(*) as record_count
from level_records group by file_id
""",
)
def kv_key_range(spark, sf_dir):
    return cl.key_ranges(_files(spark, sf_dir)).select(
        "file_id", F.hex("smallest_key").alias("smallest_hex"),
        F.hex("largest_key").alias("largest_hex"), "record_count",
    )


@_query("kv_manifest_mismatch", "select file_id from manifest where level <> 1")
def kv_manifest_mismatch(spark, sf_dir):
    """A manifest with wrong counts for level 0 and without the files below level 1: all are found."""
    have = cl.key_ranges(_files(spark, sf_dir)).withColumnsRenamed(
        {"smallest_key": "lo", "largest_key": "hi", "record_count": "n"}
    )
    said = read_table(spark, sf_dir, "manifest").where("level < 2").withColumn(
        "record_count", F.when(F.col("level") == 0, F.col("record_count") + 1).otherwise(F.col("record_count"))
    )
    same = (
        F.col("lo").eqNullSafe(F.col("smallest_key"))
        & F.col("hi").eqNullSafe(F.col("largest_key"))
        & F.col("n").eqNullSafe(F.col("record_count"))
    )
    return have.join(said, "file_id", "full_outer").where(~same).select("file_id")


@_query(
    "kv_bad_checksums", f"select arrival_no from wal_records where value is not null and {_sql_begins(TAMPERED)}"
)
def kv_bad_checksums(spark, sf_dir):
    """Values that do not have the CRC32 written with them: those that were tampered with."""
    altered = F.when(_begins(TAMPERED), F.concat("value", F.lit(b"!"))).otherwise(F.col("value"))
    return cl.bad_checksums(_log(spark, sf_dir).withColumn("value", altered)).select("arrival_no")


@_query(
    "kv_value_refs",
    f"""
select hex(key) as key_hex, case when ok then md5(value) end as value_md5, ok from (
    select *, not ({_sql_begins(TAMPERED)} or {_sql_begins(LOST)}) as ok from wal_records where value is not null
)
""",
)
def kv_value_refs(spark, sf_dir):
    """Values kept apart from the index, resolved by reference: some are damaged, some lost."""
    log = _log(spark, sf_dir).where(F.col("value").isNotNull())
    index = log.select("key", F.col("arrival_no").alias("ref"))
    altered = F.when(_begins(TAMPERED), F.concat("value", F.lit(b"!"))).otherwise(F.col("value"))
    values = log.where(~_begins(LOST)).select(F.col("arrival_no").alias("ref"), altered.alias("value"), "checksum")
    return cl.resolve_references(index, values).select(
        F.hex("key").alias("key_hex"), F.md5("value").alias("value_md5"), "ok"
    )


_BLOOM = """
with f as (
    select file_id, bloom_bits, bloom_hashes, bloom_filter from manifest
    where bloom_filter is not null and bloom_bits > 0 and bloom_hashes > 0
), probes as (
    select r.file_id as own_id, f.file_id, r.key, md5(r.key) as d, bloom_bits, bloom_hashes, bloom_filter
    from level_records r join f on f.file_id = r.file_id {other}
), bits as (
    select own_id, file_id, key, bloom_filter, (
        (('0x' || substr(d, 1, 16))::hugeint + i * ('0x' || substr(d, 17, 16))::hugeint)
        % 18446744073709551616 % bloom_bits)::bigint as bit
    from probes, generate_series(0, 63) g(i) where i < bloom_hashes
), tested as (
    select own_id, file_id, key,
        min(('0x' || substr(hex(bloom_filter), (2 * (bit // 8) + 1)::int, 2))::int >> (bit % 8)::int & 1) as has
    from bits group by all
)
select file_id, count(*) as n_keys, sum(has)::bigint as n_contained from tested group by file_id
"""


def _bloom(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    filters = read_table(spark, sf_dir, "manifest").select(
        "file_id", "bloom_bits", "bloom_hashes", "bloom_filter"
    )
    keys = _files(spark, sf_dir).select((F.col("file_id") + shift).alias("file_id"), "key").distinct()
    has = bloom_contains(F.col("key"), F.col("bloom_bits"), F.col("bloom_hashes"), F.col("bloom_filter"))
    return (
        keys.join(filters, "file_id").withColumn("has", has).where(F.col("has").isNotNull())
        .groupBy("file_id")
        .agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("has"), 1)).alias("n_contained"))
    )


@_query("kv_bloom_members", _BLOOM.format(other=""))
def kv_bloom_members(spark, sf_dir):
    """Each file's keys in its own Bloom filter: all of them are contained."""
    return _bloom(spark, sf_dir, 0)


@_query("kv_bloom_neighbours", _BLOOM.format(other="+ 1"))
def kv_bloom_neighbours(spark, sf_dir):
    """Each file's keys in the next file's filter: shared keys and false positives."""
    return _bloom(spark, sf_dir, 1)


@_query(
    "bench_summary",
    """
select engine, batch_size, min(elapsed_ns) as min_ns, median(elapsed_ns) as median_ns, max(elapsed_ns) as max_ns,
    round(sum(mutations) * 1e9 / sum(elapsed_ns), 6) as mutations_per_s
from (select distinct sample_id, engine, batch_size, mutations, elapsed_ns from measurements)
where engine is not null and batch_size is not null and elapsed_ns > 0 group by all
""",
)
def bench_summary(spark, sf_dir):
    """Minimum, median, maximum and throughput of each benchmark setting."""
    runs = read_table(spark, sf_dir, "measurements").select(
        "sample_id", "engine", "batch_size", "mutations", "elapsed_ns"
    )
    return (
        runs.where("engine is not null and batch_size is not null and elapsed_ns > 0")
        .distinct()
        .groupBy("engine", "batch_size")
        .agg(
            F.min("elapsed_ns").alias("min_ns"),
            F.median("elapsed_ns").alias("median_ns"),
            F.max("elapsed_ns").alias("max_ns"),
            F.round(F.sum("mutations") * F.lit(1e9) / F.sum("elapsed_ns"), 6).alias("mutations_per_s"),
        )
    )

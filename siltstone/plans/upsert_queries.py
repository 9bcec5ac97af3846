"""Queries of the change feed in wal_records and wal_commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import upsert
from siltstone.sources.shared import read_table, scratch_table


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = read_table(spark, sf_dir, "wal_records").withColumnRenamed("record_type", "op")
    commits = read_table(spark, sf_dir, "wal_commits")
    state = upsert.apply_changes(wal, commits)
    return upsert.publish_state(state, scratch_table(spark, f"wal_state-{uuid.uuid4().hex}"))  # one per call


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys after all committed changes, with the lsn of the put that holds."""
    return upsert.live_rows(_state(spark, sf_dir)).select(F.hex("key").alias("key_hex"), "lsn")


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rebuilt table with tombstones and the md5 of each value."""
    return shown(_state(spark, sf_dir))


def shown(state: DataFrame) -> DataFrame:
    return state.select(
        F.hex("key").alias("key_hex"), "lsn", F.col("op").cast("int").alias("op"),
        F.md5("value").alias("value_md5"),
    )


_HOLDING = """
with counting as (
    select key, lsn, record_type, value from wal_records
    where key is not null and lsn is not null and record_type in (1, 2)
      and (txn_id is null or txn_id in (select txn_id from wal_commits where txn_id is not null))
), holding as (
    select * from counting
    qualify row_number() over
        (partition by key order by lsn desc, record_type desc, value desc nulls last) = 1
)
"""

QUERIES = {"p4_found": p4_found, "p4_state": p4_state}
ORACLE_SQL = {
    "p4_found": _HOLDING + "select hex(key) as key_hex, lsn from holding where record_type = 1",
    "p4_state": _HOLDING
    + "select hex(key) as key_hex, lsn, record_type::int as op, md5(value) as value_md5 from holding",
}

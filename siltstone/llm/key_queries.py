"""Repeated keys in key_records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import seen_keys
from siltstone.sources.shared import read_table, shared_dir, stacked


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "key_records"), read_table(spark, sf_dir, "level_records")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key stood in a sealed file or an earlier row."""
    return seen_keys.seen_before(*_tables(spark, sf_dir))


def p1_wrong_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured share of wrong claims, in the setting of p1_found."""
    return seen_keys.wrong_rate(*_tables(spark, sf_dir))


def p1_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by sealed partitions that are kept: the files first, then the records in three runs."""
    records, files = _tables(spark, sf_dir)
    folder = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/sealed-{uuid.uuid4().hex}"
    kept = seen_keys.SealedKeys(spark, folder, expected_keys=records.count() + files.count())
    kept.add(files.select("key", F.monotonically_increasing_id().alias("record_id")))
    low, high = records.agg(F.min("record_id"), F.max("record_id")).first()
    found = []
    for k in range(3):
        within = F.floor((F.col("record_id") - F.lit(low or 0)) * 3 / F.lit((high or 0) - (low or 0) + 1)) == k
        found.append(kept.add(records.where(within)))
        if k == 1:
            kept.merge()
    return stacked(*found)


QUERIES = {"p1_found": p1_found, "p1_wrong_rate": p1_wrong_rate, "p1_resumed": p1_resumed}
ORACLE_SQL = {
    "p1_found": """
with firsts as (
    select key, min(record_id) as first from key_records where key is not null group by key
)
select record_id from key_records k join firsts f on k.key = f.key
where k.record_id > f.first
   or k.key in (select key from level_records where key is not null)
"""
}
ORACLE_SQL["p1_resumed"] = ORACLE_SQL["p1_found"]

"""Running aggregates along a global order, without one task that sees all rows.

A frame is range-partitioned and sorted by the order and written out once with the
number of each row's range; everything after is computed from that one copy. A
running value is the one within the row's range, combined with the total of all
ranges before. There are as many totals as ranges, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.sources.shared import checkpointed

RANGE = "_range"
_AGGREGATES = {"sum": F.sum, "max": F.max}


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_range``, the number of the key range that a row was written to.

    The number is part of the written copy: a plan that numbered the ranges anew for
    every use would let them be drawn, or joined together, differently each time.
    """
    return checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(RANGE, F.spark_partition_id())
    )


def running(ranged: DataFrame, order: list[str], name: str, value: Column, kind: str = "sum") -> DataFrame:
    """``ranged`` with the running sum or maximum of ``value`` up to and with each row.

    ``ranged`` comes from ``in_ranges`` by the same order, in which no two rows may be
    equal. A sum counts null as 0, a maximum passes over it.
    """
    if kind == "sum":
        value = F.coalesce(value, F.lit(0)).cast("long")
    aggregate = _AGGREGATES[kind]
    within = W.partitionBy(RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy(RANGE).agg(aggregate(value).alias("_total"))
    ahead = aggregate("_total").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
    before = totals.select(RANGE, ahead.alias("_before"))
    here = aggregate(value).over(within)
    joined = ranged.withColumn("_here", here).join(F.broadcast(before), RANGE)  # a row per range
    if kind == "sum":
        whole = F.col("_here") + F.coalesce("_before", F.lit(0))
    else:
        whole = F.greatest("_here", "_before")  # skips nulls
    return joined.withColumn(name, whole).drop("_here", "_before")

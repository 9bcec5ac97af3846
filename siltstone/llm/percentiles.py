"""Percentiles per group from mergeable sketches, and exact ones from their bounds.

The sketch is a hierarchy of randomized compactors (KLL): a full level is sorted,
every other value moves up with double weight, and two sketches merge level by
level. Spark's own aggregate is used, in the JVM with partial aggregation, so a hot
group reaches the shuffle as one sketch per task. A percentile read from a sketch is
off by at most ``rank_error(k)`` of the ranks with 99 % confidence, whatever the
partitions, days or merges that it came through.

Where the exact value is asked for, the sketch gives bounds around it; a pass counts
what lies below and between them, which proves the bounds or widens them, and only
the values between are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.sources.shared import checkpointed, stacked

#: Values between the bounds of one percentile that a single task may sort.
FINISH_ROWS = 1_000_000


def rank_error(k: int) -> float:
    """Rank error of one percentile at 99 % confidence, as a fraction of all ranks."""
    return 2.296 / k**0.9021


def sketches(values: DataFrame, groups: list[str], value: str, k: int = 800) -> DataFrame:
    """(groups, sketch, n, least, most): one sketch per group over non-null values."""
    v = F.col(value).cast("long")
    return (
        values.where(F.col(value).isNotNull())
        .groupBy(*groups)
        .agg(
            F.kll_sketch_agg_bigint(v, k).alias("sketch"),
            F.count("*").alias("n"),
            F.min(v).alias("least"),
            F.max(v).alias("most"),
        )
    )


def merged(parts: DataFrame, groups: list[str], k: int = 800) -> DataFrame:
    """Sketches of coarser groups, or of more days, put together from parts."""
    return parts.groupBy(*groups).agg(
        F.kll_merge_agg_bigint("sketch", k).alias("sketch"),
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )


def bounded(parts: DataFrame, groups: list[str], pcts: list[int], k: int = 800, width: float = 1.5) -> DataFrame:
    """(groups, pct, n, rank, lo, approx, hi): each percentile with bounds from the sketch.

    ``rank`` is that of the smallest value that at least pct in a hundred values do
    not exceed. The bounds lie ``width`` rank errors to either side.
    """
    e = width * rank_error(k)
    few = F.col("n") * e <= 1  # so few values that a rank error is less than one of them: all lie within

    def read(share: float):
        return F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(share)))

    def one(pct: int):
        share = pct / 100
        lo = read(share - e) if share > e else F.col("least")
        hi = read(share + e) if share + e < 1 else F.col("most")
        return F.struct(
            F.lit(pct).alias("pct"),
            F.when(few, F.col("least")).otherwise(lo).alias("lo"),
            read(share).alias("approx"),
            F.when(few, F.col("most")).otherwise(hi).alias("hi"),
        )

    rank = F.greatest(F.ceil(F.col("n") * F.col("p.pct") / 100), F.lit(1)).cast("long")
    return parts.withColumn("p", F.explode(F.array(*map(one, pcts)))).select(
        *groups, "p.pct", "n", rank.alias("rank"), "p.lo", "p.approx", "p.hi", "least", "most"
    )


#: Steps of the ranks at which a sketch is read where the rank depends on the row.
GRID = 512


def _read_outside(share: Column, up: bool) -> Column:
    """The sketch's value at the next grid step below or above ``share``."""
    grid = F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    step = F.ceil(share * GRID) if up else F.floor(share * GRID)
    return F.get(grid, F.least(F.greatest(step, F.lit(0)), F.lit(GRID)).cast("int"))


def _between(values: DataFrame, groups: list[str], value: str, bounds: DataFrame) -> DataFrame:
    """Each value with the percentiles of its group, one row per percentile."""
    return values.select(*groups, F.col(value).cast("long").alias("v")).join(bounds, groups)


def exact(values: DataFrame, groups: list[str], value: str, bounds: DataFrame, k: int = 800) -> DataFrame:
    """(groups, pct, n, value): exact percentiles within proven bounds.

    ``values`` holds no nulls in groups and value; it is read twice, and twice more
    for each narrowing of bounds that hold over ``FINISH_ROWS`` values.
    """
    key = [*groups, "pct"]
    t, before = checkpointed(bounds), float("inf")
    while True:
        counts = (
            _between(values, groups, value, t)
            .groupBy(*key)
            .agg(
                F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"),
                F.count(F.when(F.col("v").between(F.col("lo"), F.col("hi")), 1)).alias("inside"),
            )
        )
        holds = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("inside"))
        t = checkpointed(
            t.drop("below", "inside")
            .join(counts, key)
            .withColumn("lo", F.when(holds, F.col("lo")).otherwise(F.col("least")))
            .withColumn("hi", F.when(holds, F.col("hi")).otherwise(F.col("most")))
            .withColumn("inside", F.when(holds, F.col("inside")).otherwise(F.col("n")))
            .withColumn("below", F.when(holds, F.col("below")).otherwise(F.lit(0)))
        )
        wide = (F.col("inside") > FINISH_ROWS) & (F.col("lo") < F.col("hi"))
        most = t.where(wide).agg(F.max("inside")).first()[0]
        if most is None or most > 0.9 * before:  # repeated values do not get narrower
            break
        before = most
        inner = (
            _between(values, groups, value, t.where(wide).select(*key, "lo", "hi"))
            .where(F.col("v").between(F.col("lo"), F.col("hi")))
        )
        again = sketches(inner, key, "v", k).withColumnsRenamed({"n": "m", "least": "l", "most": "h"})
        share = (F.col("rank") - F.col("below")) / F.col("m")
        e = 1.5 * rank_error(k)
        none = F.col("sketch").isNull()
        t = checkpointed(
            t.join(again, key, "left")
            .withColumn("lo", F.when(none, F.col("lo")).when(share <= e, F.col("l")).otherwise(_read_outside(share - e, False)))
            .withColumn("hi", F.when(none, F.col("hi")).when(share + e >= 1, F.col("h")).otherwise(_read_outside(share + e, True)))
            .drop("sketch", "m", "l", "h")
        )
    runs = (
        _between(values, groups, value, t.select(*key, "n", "rank", "lo", "hi", "below"))
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*key, "n", "rank", "below", "v")
        .agg(F.count("*").alias("c"))
    )
    upto = F.sum("c").over(W.partitionBy(*key).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    target = F.col("rank") - F.col("below")
    return (
        runs.withColumn("upto", upto)
        .where((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target))
        .select(*key, "n", F.col("v").alias("value"))
    )


def samples(measurements: DataFrame) -> DataFrame:
    """Distinct samples (sample_id, engine, batch_size, elapsed_ns, run_day) that count.

    A sample needs non-null id, engine and batch_size and a positive elapsed_ns. A
    sample sent again with the same fields counts once.
    """
    return (
        measurements.where(
            F.col("sample_id").isNotNull()
            & F.col("engine").isNotNull()
            & F.col("batch_size").isNotNull()
            & (F.col("elapsed_ns") > 0)
        )
        .select("sample_id", "engine", "batch_size", "elapsed_ns", "run_day")
        .distinct()
    )


SETTING = ["engine", "batch_size"]
#: The scope of all days, next to those of single ones.
ALL_DAYS = "all"


def slow_days(
    measurements: DataFrame, pcts: list[int], *, least_samples: int = 8, factor: int = 2, k: int = 800
) -> DataFrame:
    """Days on which a percentile is at least ``factor`` times that of all days.

    (engine, batch_size, run_day, pct, value, all_value), run_day as YYYY-MM-DD. Samples
    without run_day count towards all days only. Empty tables give no rows. The bounds of
    days and of all days are proven and finished together, so that the samples are
    counted once and sorted once for both.
    """
    rows = checkpointed(samples(measurements).withColumn("run_day", F.date_format("run_day", "yyyy-MM-dd")))
    days = [*SETTING, "run_day"]
    daily = checkpointed(sketches(rows, days, "elapsed_ns", k))
    overall = merged(daily, SETTING, k).withColumn("run_day", F.lit(ALL_DAYS))
    dated = daily.where(F.col("run_day").isNotNull() & (F.col("n") >= least_samples))
    bounds = bounded(stacked(dated, overall), days, pcts, k)
    scopes = F.explode(F.array_compact(F.array(F.lit(ALL_DAYS), "run_day")))
    scoped = rows.select(*SETTING, scopes.alias("run_day"), "elapsed_ns")
    found = checkpointed(exact(scoped, days, "elapsed_ns", bounds, k))
    of_all = found.where(F.col("run_day") == ALL_DAYS).select(*SETTING, "pct", F.col("value").alias("all_value"))
    of_day = found.where(F.col("run_day") != ALL_DAYS)
    return of_day.join(of_all, [*SETTING, "pct"]).where(F.col("value") >= F.col("all_value") * factor)


def measured_error(values: DataFrame, groups: list[str], value: str, bounds: DataFrame) -> DataFrame:
    """(groups, pct, n, error): how far each sketched percentile's rank is from its own.

    The rank error is that of the nearest rank that the value ``approx`` takes, as a
    share of all values; ``bounds`` come from ``bounded``.
    """
    key = [*groups, "pct"]
    counts = (
        _between(values, groups, value, bounds.select(*key, "n", "rank", "approx"))
        .groupBy(*key, "n", "rank")
        .agg(
            F.count(F.when(F.col("v") < F.col("approx"), 1)).alias("below"),
            F.count(F.when(F.col("v") <= F.col("approx"), 1)).alias("upto"),
        )
    )
    off = F.greatest(F.col("below") + 1 - F.col("rank"), F.col("rank") - F.col("upto"), F.lit(0))
    return counts.select(*key, "n", (off / F.col("n")).alias("error"))

"""Percentiles of measurements.elapsed_ns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import percentiles
from siltstone.sources.shared import checkpointed, read_table

PCTS = [50, 90]
PARTS = [1, 25, 50, 75, 90, 99]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a median or 90th percentile is twice that of all days or more."""
    return percentiles.slow_days(read_table(spark, sf_dir, "measurements"), PCTS).select(
        "engine", "batch_size", "run_day", "pct"
    )


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of all days per setting, from bounds of the merged daily sketches."""
    rows = checkpointed(percentiles.samples(read_table(spark, sf_dir, "measurements")))
    daily = percentiles.sketches(rows, [*percentiles.SETTING, "run_day"], "elapsed_ns")
    every = percentiles.merged(daily, percentiles.SETTING)
    bounds = percentiles.bounded(every, percentiles.SETTING, PARTS)
    return percentiles.exact(rows, percentiles.SETTING, "elapsed_ns", bounds)


def p2_rank_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile of merged daily sketches is within the rank error that is stated.

    Twice the error at 99 % confidence is allowed, which chance alone will not exceed.
    """
    rows = checkpointed(percentiles.samples(read_table(spark, sf_dir, "measurements")))
    daily = percentiles.sketches(rows, [*percentiles.SETTING, "run_day"], "elapsed_ns")
    every = percentiles.merged(daily, percentiles.SETTING)
    bounds = checkpointed(percentiles.bounded(every, percentiles.SETTING, PARTS))
    found = percentiles.measured_error(rows, percentiles.SETTING, "elapsed_ns", bounds)
    return found.select(
        "engine", "batch_size", "pct", "n", (F.col("error") <= 2 * percentiles.rank_error(800)).alias("within")
    )


QUERIES = {"p2_found": p2_found, "p2_percentiles": p2_percentiles, "p2_rank_error": p2_rank_error}

_SAMPLES = """
with samples as (
    select distinct sample_id, engine, batch_size, elapsed_ns, run_day from measurements
    where sample_id is not null and engine is not null and batch_size is not null and elapsed_ns > 0
), pcts as (select unnest({pcts})::int as pct),
overall as (
    select *, row_number() over (partition by engine, batch_size order by elapsed_ns) as r,
        count(*) over (partition by engine, batch_size) as n
    from samples
), of_all as (
    select engine, batch_size, pct, min(n) as n, min(elapsed_ns) as value
    from overall, pcts where r * 100 >= n * pct group by all
)
"""

ORACLE_SQL = {
    "p2_percentiles": _SAMPLES.format(pcts=PARTS) + "select * from of_all",
    "p2_rank_error": _SAMPLES.format(pcts=PARTS) + "select engine, batch_size, pct, n, true as within from of_all",
    "p2_found": _SAMPLES.format(pcts=PCTS)
    + """, daily as (
    select *, row_number() over (partition by engine, batch_size, run_day order by elapsed_ns) as r,
        count(*) over (partition by engine, batch_size, run_day) as n
    from samples where run_day is not null
), of_day as (
    select engine, batch_size, run_day, pct, min(elapsed_ns) as value
    from daily, pcts where n >= 8 and r * 100 >= n * pct group by all
)
select engine, batch_size, strftime(run_day, '%Y-%m-%d') as run_day, pct
from of_day join of_all using (engine, batch_size, pct) where of_day.value >= 2 * of_all.value
""",
}

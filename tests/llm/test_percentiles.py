"""Sketches within their bound, and exact percentiles against sorting."""

import random
from datetime import date

from pyspark.sql import functions as F

from siltstone.llm import percentiles as pc

SCHEMA = "sample_id bigint, engine string, batch_size int, elapsed_ns bigint, run_day date, received_at int, sketch int"


def nearest(values, pct):
    values = sorted(values)
    return values[max(1, -(-len(values) * pct // 100)) - 1]


def sample(seed, n):
    rng = random.Random(seed)
    days = [date(2021, 3, d) for d in range(1, 5)]
    rows = []
    for i in range(n):
        slow = rng.random() < 0.2
        rows.append((i, rng.choice(["a", "b", None]), rng.choice([1, 16, None]),
                     rng.choice([None, -1, 0, int(rng.lognormvariate(9 + 3 * slow, 1)), 777, 777]), rng.choice([*days, None]), 0, 0))
    return rows + rows[: n // 5]


def test_exact_percentiles(spark):
    rows = sample(1, 4000)
    df = pc.samples(spark.createDataFrame(rows, SCHEMA).repartition(5))
    bounds = pc.bounded(pc.sketches(df, pc.SETTING, "elapsed_ns", k=64), pc.SETTING, [1, 50, 90, 100], k=64)
    got = {(r["engine"], r["batch_size"], r["pct"]): (r["n"], r["value"]) for r in pc.exact(df, pc.SETTING, "elapsed_ns", bounds, 64).collect()}
    groups = {}
    for r in {r[:5] for r in rows}:
        if r[1] and r[2] and r[3] and r[3] > 0:
            groups.setdefault(r[1:3], []).append(r[3])
    assert got == {(*g, p): (len(v), nearest(v, p)) for g, v in groups.items() for p in [1, 50, 90, 100]}


def test_narrowing_and_wrong_bounds(spark, monkeypatch):
    monkeypatch.setattr(pc, "FINISH_ROWS", 50)
    values = [random.Random(2).randrange(10**6) for _ in range(5000)] + [5] * 3000
    df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
    wrong = pc.bounded(pc.sketches(df, ["g"], "v", k=32), ["g"], [50, 90], k=32).withColumn(
        "lo", F.when(F.col("pct") == 50, F.col("hi")).otherwise(F.col("lo"))
    ).withColumn("hi", F.when(F.col("pct") == 50, F.col("hi") + 1).otherwise(F.col("hi")))
    got = {r["pct"]: r["value"] for r in pc.exact(df, ["g"], "v", wrong, 32).collect()}
    assert got == {50: nearest(values, 50), 90: nearest(values, 90)}


def test_merged_sketches_stay_within_bound(spark):
    n = 60_000
    df = spark.range(n).select(
        F.lit("g").alias("g"), (F.col("id") % 13).alias("day"), ((F.col("id") * 7919) % n).alias("v")
    )
    parts = pc.sketches(df, ["g", "day"], "v", 200)
    rows = pc.bounded(pc.merged(parts, ["g"], 200), ["g"], list(range(1, 100)), 200).collect()
    worst = max(abs(r["approx"] - r["pct"] * n / 100) / n for r in rows)
    assert worst <= 1.5 * pc.rank_error(200)
    assert all(r["lo"] <= r["pct"] * n / 100 <= r["hi"] + 1 for r in rows)


def test_slow_days(spark):
    rows = sample(3, 3000) + [(10_000 + i, "a", 1, 10**9, date(2021, 3, 9), 0, 0) for i in range(8)]
    rows += [(20_000 + i, "a", 1, 10**9, date(2021, 3, 10), 0, 0) for i in range(7)]
    got = {(r["engine"], r["batch_size"], str(r["run_day"]), r["pct"]) for r in pc.slow_days(spark.createDataFrame(rows, SCHEMA), [50, 90]).collect()}
    every, daily = {}, {}
    for r in {r[:5] for r in rows}:
        if r[1] and r[2] and r[3] and r[3] > 0:
            every.setdefault(r[1:3], []).append(r[3])
            if r[4]:
                daily.setdefault((*r[1:3], str(r[4])), []).append(r[3])
    want = {(*k, p) for k, v in daily.items() for p in (50, 90) if len(v) >= 8 and nearest(v, p) >= 2 * nearest(every[k[:2]], p)}
    assert got == want and ("a", 1, "2021-03-09", 50) in got
    assert pc.slow_days(spark.createDataFrame([], SCHEMA), [50]).count() == 0

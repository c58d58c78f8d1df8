"""Orders, numbers and running sums over many ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import progress, running
from reelmill.plans import library as plans
from reelmill.operators.predict import HEAVY_SECONDS


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_scan_order_numbers_every_file_once(spark, coalesce):
    """Under adaptive execution, with a further column, in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    scan = spark.range(300_000).select(F.concat(F.lit("/lib/"), F.sha1(F.col("id").cast("string"))).alias("path"), F.rand(1).alias("more"))
    for parts in (1, 16):
        rows = plans.in_scan_order(scan, parts)
        one = rows.agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.countDistinct("path").alias("paths")).first()
        assert tuple(one) == (300_000, 300_000, 1, 300_000, 300_000)
    first = [r.path for r in rows.where("seq <= 500 or seq > 299500").orderBy("seq").collect()]
    paths = sorted(r.path for r in scan.select("path").collect())
    assert first == paths[:500] + paths[-500:]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_of_plans(spark):
    rows = spark.createDataFrame([("b", "/2/b"), ("a", "/9/a"), ("b", "/1/b"), ("c", "/0/c")], "name string, path string")
    assert [r.path for r in plans.dry_run(rows).collect()] == ["/9/a", "/1/b", "/2/b", "/0/c"]
    assert plans.first_file(rows).first().path == "/0/c"
    assert [r.seq for r in plans.in_scan_order(rows, 3).orderBy("path").collect()] == [1, 2, 3, 4]
    assert plans.in_scan_order(rows.limit(0)).count() == 0


def events(n):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, None]), start + dt.timedelta(seconds=rng.randrange(n // 2)), rng.choice([0.1, 10.0, 30.0]), rng.random() * 9) for i in range(n)]
    return rows, "event_id long, run long, ts timestamp, predicted double, real double"


def slow_trace(rows):
    out = {}
    for run in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == run), key=lambda r: (r[2], r[0]))
        heavy_all, light_all = sum(r[3] for r in own if r[3] >= HEAVY_SECONDS), sum(r[3] < HEAVY_SECONDS for r in own)
        p = h = light = 0.0
        n, before = 0, None
        for r in own:
            if r[3] >= HEAVY_SECONDS:
                p, h = p + r[3], h + r[4]
            else:
                light, n = light + r[4], n + 1
            rate = min(5.0, max(0.2, h / p if p > 30 else 1.0))
            gap = 0 if before is None else round((r[2] - before).total_seconds() * 1e6)
            out[r[0]] = round(max(0.0, (heavy_all - p) * rate + (light_all - n) * (light / n if n > 20 else 0.1)), 6), gap
            before = r[2]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_one_run_with_most_rows_is_many_ranges(spark, parts):
    rows, schema = events(600)
    df = spark.createDataFrame(rows, schema)
    eta = {r.event_id: r.eta for r in progress.trace(df, "run", ["ts", "event_id"], "predicted", "real", parts).collect()}
    gap = {r.event_id: r.gap_us for r in progress.gaps(df, "run", ["ts", "event_id"], "ts", parts).collect()}
    expected = slow_trace(rows)
    assert {i: (pytest.approx(eta[i], abs=1e-5), gap[i]) for i in eta} == {i: v for i, v in expected.items()} and len(eta) == 600


def test_no_window_spans_a_run(spark):
    rows, schema = events(200)
    df = progress.trace(spark.createDataFrame(rows, schema), "run", ["ts", "event_id"], "predicted", "real", 5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    over_events = [line for line in windows if running.TIE in line]  # the others are over a row a range
    assert over_events and all("windowspecdefinition(run#" in line and f", {running.PART}#" in line for line in over_events)
    one_run = spark.range(4000).select(F.lit(1).alias("run"), F.col("id"))
    sizes = [r["count"] for r in running.ranged(one_run, ["run"], ["id"], 8).groupBy(running.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_shown_reports(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.5, 0.005), ("a", 3, 1.0, 0.01), ("a", 4, 1.2, 0.0101), ("a", 5, 2.6, 0.0102), ("a", 6, 2.7, None), ("a", 7, 2.8, 0.0), ("b", 1, 9.0, 0.5), ("b", 2, 9.1, 0.501)]
    got = progress.shown(spark.createDataFrame(rows, "label string, seq long, at_s double, fraction double")).collect()
    assert sorted((r.label, r.seq) for r in got) == [("a", 1), ("a", 3), ("a", 5), ("a", 6), ("a", 7), ("b", 1)]

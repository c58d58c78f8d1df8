"""Whole plans over a library: what a run would do, what it would save, and what of it is worth picking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.quality import half_even
from reelmill.operators import predict, rules
from reelmill.operators.running import with_running
from reelmill.settings import Settings

ENCODED = ("shrink", "transcode")


def decided(media: DataFrame, s: Settings) -> DataFrame:
    return rules.decide(rules.with_rates(media), s)


def planned(media: DataFrame, s: Settings) -> DataFrame:
    """``media`` with its decision, predicted size and saving."""
    return predict.predicted(decided(media, s), s)


def estimate(plan: DataFrame, total_files: int | None = None) -> DataFrame:
    """One row: bytes before and after, files re-encoded or not, and the cohort that is worked on.

    While only part of ``total_files`` has been probed, counts and cohort bytes are scaled up to all.
    """
    work = F.coalesce(F.col("mode").isin(*ENCODED), F.lit(False))
    one = plan.agg(
        F.count("*").alias("sample"), F.coalesce(F.sum("size"), F.lit(0)).alias("src_bytes"), F.coalesce(F.sum("predicted"), F.lit(0)).alias("out_bytes"),
        F.count_if(work).alias("encoded"), F.coalesce(F.sum(F.when(work, F.col("size"))), F.lit(0)).alias("work_src"), F.coalesce(F.sum(F.when(work, F.col("predicted"))), F.lit(0)).alias("work_out"),
    )
    scale = F.lit(1.0) if total_files is None else F.when(F.col("sample") > 0, F.lit(float(total_files)) / F.col("sample")).otherwise(1.0)
    percent = lambda out, src: F.when(src > 0, half_even((1 - out / src) * 100)).otherwise(0.0).cast("long")
    return one.select(
        "src_bytes", "out_bytes", percent(F.col("out_bytes"), F.col("src_bytes")).alias("saved_pct"),
        half_even(F.col("encoded") * scale).cast("long").alias("reencoded"), half_even((F.col("sample") - F.col("encoded")) * scale).cast("long").alias("skipped"),
        (F.col("work_src") * scale).alias("work_bytes"), (F.col("work_out") * scale).alias("work_out_bytes"),
        (F.greatest(F.lit(0), F.col("work_src") - F.col("work_out")) * scale).alias("work_saved_bytes"), percent(F.col("work_out"), F.col("work_src")).alias("work_saved_pct"),
    )


def candidates(plan: DataFrame) -> DataFrame:
    """Files that would be re-encoded, with the saving by bitrate in percent."""
    saving = F.when(F.col("source_kbps") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("target_kbps") / F.col("source_kbps"))).otherwise(0.0)
    return plan.where(F.col("mode").isin(*ENCODED)).select(
        "file_id", "path", F.col("size").alias("bytes"), F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("resolution"),
        "duration", half_even(saving * 100).cast("long").alias("saving"),
    )


def dry_run_totals(plan: DataFrame) -> DataFrame:
    """Files of a dry run, those with a saving, their bytes, the bytes saved and the share of all."""
    gains = F.coalesce(F.col("saving") > 0, F.lit(False))
    saved = F.floor(F.col("size") * F.col("saving")).cast("long")
    one = plan.agg(F.count("*").alias("files"), F.count_if(gains).alias("saving_files"), F.sum(F.when(gains, F.col("size")).otherwise(0)).alias("bytes"), F.sum(F.when(gains, saved).otherwise(0)).alias("saved"))
    return one.withColumn("percent", F.when(F.col("bytes") > 0, F.col("saved") / F.col("bytes") * 100).otherwise(0.0))


def estimate_state(probes: DataFrame, work_files: int, done: bool) -> str:
    """Where an estimate stands: ready, still probing, or empty (all probed, nothing to work on)."""
    if work_files and not probes.isEmpty():
        return "ready"
    return "empty" if done else "probing"


def mean_work(plan: DataFrame, hardware: bool = True) -> DataFrame:
    """One row: the mean seconds of a probed file, those left alone included; without any, that of five minutes of video."""
    speed = predict.HARDWARE_SPEED if hardware else predict.SOFTWARE_SPEED
    return plan.agg(F.coalesce(F.avg(predict.work_seconds(F.lit(False), hardware)), F.lit(300.0 / speed)).alias("mean"))


def in_scan_order(scan: DataFrame, parts: int | None = None) -> DataFrame:
    """``scan`` with ``seq``, the place of each file in path order from 1, without a gap; no task holds the whole library."""
    return with_running(scan, ["path"], {"seq": F.lit(1).cast("long")}, parts=parts).drop("seq_all")


def first_file(scan: DataFrame) -> DataFrame:
    """The file that a preview shows: the first in scan order."""
    return scan.orderBy("path").limit(1)


def dry_run(plan: DataFrame) -> DataFrame:
    """The rows of a dry run by file name, then path."""
    return plan.orderBy("name", "path")

"""Predicted sizes, savings and working time of decided files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.settings import PIXELS_1080P, Settings

#: Encoding speeds in times real time at 1080p, seconds of a remux and a skip, seconds from which a file is heavy.
HARDWARE_SPEED, SOFTWARE_SPEED, REMUX_SECONDS, SKIP_SECONDS, HEAVY_SECONDS = 6.0, 0.82, 10.0, 0.10, 5.0


def output_bytes(s: Settings) -> Column:
    """Size after the run: video at its target, the rest as it is or at the rate of the audio policy."""
    size, dur, source, target, rate = (F.col(c) for c in ("size", "duration", "source_kbps", "target_kbps", "bit_rate"))
    rest = F.greatest(F.lit(0.0), size - rate / 8.0 * dur)
    if s.audio_policy in ("aac", "ac3"):
        per = F.when(q.max_channels(F.col("audio")) > 2, s.audio_kbps_multichannel).otherwise(s.audio_kbps_stereo)
        rest = F.when(F.size("audio") > 0, per * 1000.0 / 8.0 * dur * F.size("audio")).otherwise(rest)
    split = F.least(size.cast("double"), target * 1000.0 / 8.0 * dur + rest)
    scaled = F.least(size.cast("double"), size * F.least(F.lit(1.0), target / source))
    same = F.col("mode").isNull() | (F.col("mode") == "remux") | (dur <= 0) | (target <= 0) | (source <= 0)
    return F.when(same, size).when(rate == 0, scaled.cast("long")).otherwise(split.cast("long"))


def projected_saving() -> Column:
    """Share saved: null for files left alone or of unknown rate, 0 for remuxes."""
    by_size = F.greatest(F.lit(0.0), 1.0 - F.col("predicted") / F.col("size"))
    by_rate = F.greatest(F.lit(0.0), 1.0 - F.col("target_kbps") / F.col("source_kbps"))
    return (
        F.when(F.col("mode") == "remux", 0.0).when(~F.coalesce(F.col("mode").isin("shrink", "transcode"), F.lit(False)), None)
        .when(F.col("size") > 0, by_size).when(F.col("source_kbps") > 0, by_rate)
    )


def work_seconds(picked: Column, hardware: bool = True) -> Column:
    """Seconds that a decided file takes: encodes by duration and size, at software speed where ``picked``."""
    speed = F.when(picked, SOFTWARE_SPEED).otherwise(HARDWARE_SPEED if hardware else SOFTWARE_SPEED)
    speed = speed * F.when(F.col("pixels") > 0, F.lit(float(PIXELS_1080P)) / F.col("pixels")).otherwise(1.0)
    encode = F.when(F.col("duration") > 0, F.col("duration") / speed).otherwise(1800.0 / speed)
    return F.when(F.col("mode").isin("shrink", "transcode"), encode).when(F.col("mode") == "remux", REMUX_SECONDS).otherwise(SKIP_SECONDS)


def predicted(decided: DataFrame, s: Settings) -> DataFrame:
    return decided.withColumn("predicted", output_bytes(s)).withColumn("saving", projected_saving())

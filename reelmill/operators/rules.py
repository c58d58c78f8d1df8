"""What a run does with each file: ordered rules, each a CASE over media columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.functions.names import extension
from reelmill.settings import Settings


def first_of(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    start = F.when(*rules[0])
    return reduce(lambda case, rule: case.when(*rule), rules[1:], start).otherwise(otherwise)


def with_rates(media: DataFrame) -> DataFrame:
    """``media`` with effective_bps and source_kbps."""
    bps = q.effective_bps(F.col("bit_rate"), F.col("container_bit_rate"), F.col("audio_bps"), F.col("audio"))
    return media.withColumn("effective_bps", bps).withColumn("source_kbps", F.col("effective_bps") / 1000.0)


def verdict(mode: str | None, outcome: str | None, target: Column | int = 0) -> Column:
    return F.struct(F.lit(mode).cast("string").alias("mode"), F.lit(outcome).cast("string").alias("outcome"), (F.lit(target) if isinstance(target, int) else target).cast("long").alias("target_kbps"))


def decide(media: DataFrame, s: Settings) -> DataFrame:
    """``media`` (with rates) with mode, outcome and target_kbps: a mode for files to work on, else the reason to leave them."""
    source, pixels, fps = F.col("source_kbps"), F.col("pixels"), F.col("fps")
    category, mp4 = q.codec_class(F.col("vcodec")), F.col("ext").isin(*q.MP4_EXTS)
    aim = q.target_kbps(s, pixels, fps)
    capped = q.target_kbps(s, pixels, fps, source)
    worth = q.over_target(source, aim, s.tolerance) & (aim <= source * F.lit(s.min_saving_ratio))
    is_h264, modern, legacy = (category == x for x in ("h264", "modern", "legacy"))
    rehome = F.lit(s.remux_to_mp4) & ~mp4
    rescue = F.when(source > 0, (source * 0.85).cast("long")).otherwise(s.floor_kbps)
    unread = F.coalesce(F.col("vcodec"), F.lit("")) == ""
    if "ok" in media.columns:  # whether the probe could read the file
        unread = unread | ~F.coalesce(F.col("ok"), F.lit(False))
    rules = [
        (unread, verdict(None, "skip-codec")),
        (F.lit(s.leave_non_mp4) & ~mp4, verdict(None, "skip-non-mp4")),
        (F.col("own_work") & F.lit(not s.allow_second_generation), verdict(None, "skip-second-generation")),
        (is_h264 & worth, verdict("shrink", None, capped)),
        (is_h264 & rehome, verdict("remux", None)),
        (is_h264 & (source > 0) & (source < aim * F.lit(2.0 - s.tolerance)), verdict(None, "skip-under-tier")),
        (is_h264, verdict(None, "skip-at-tier")),
        (modern & rehome, verdict("remux", None)),
        (modern, verdict(None, "skip-modern")),
        (legacy & F.lit(s.compat_transcode), verdict("transcode", None, rescue)),
        (legacy, verdict(None, "skip-incompatible")),
    ]
    return media.withColumn("verdict", first_of(rules, verdict(None, "skip-codec"))).select("*", "verdict.*").drop("verdict")


def ignore_reason(name: Column, size: Column, s: Settings) -> Column:
    """Why the scan leaves a file out, or null: size rules, then endings, then parts of the name. A null size abstains."""
    rules: list[tuple[Column, Column]] = []
    if s.ignore_under > 0:
        rules.append((size < s.ignore_under, F.lit("smaller than the limit")))
    if s.ignore_over > 0:
        rules.append((size > s.ignore_over, F.lit("larger than the limit")))
    endings = [x for x in (e.strip().lstrip(".").lower() for e in s.ignore_exts) if x]
    if endings:
        rules.append((extension(name).isin(*endings), F.concat(F.lit("ending ."), extension(name), F.lit(" is ignored"))))
    for part in (p.strip().lower() for p in s.ignore_names):
        if part:
            rules.append((F.contains(F.lower(name), F.lit(part)), F.lit(f"name has {part}")))
    return first_of(rules, F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def own_work(tags: Column | None, comment: Column, mark: str) -> Column:
    """Whether a file says that a lossy run of ours made it; a remux doesn't count. Our tags begin with ``mark`` in capitals."""
    low = F.lower(F.coalesce(comment, F.lit("")))
    said = F.contains(low, F.lit(mark.lower())) & (F.contains(low, F.lit("shrink")) | F.contains(low, F.lit("transcode")))
    return said if tags is None else F.coalesce(F.element_at(tags, f"{mark.upper()}_MODE").isin("shrink", "transcode"), F.lit(False)) | said

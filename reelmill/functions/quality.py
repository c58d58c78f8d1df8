"""Codec classes, bitrates and quality targets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelmill.settings import PIXELS_1080P, PIXELS_4K, Settings

#: Codec names by what a run does with them.
H264 = ("h264", "avc")
MODERN = ("hevc", "av1", "vp9")
LEGACY = ("mpeg2video", "mpeg4", "msmpeg4v1", "msmpeg4v2", "msmpeg4v3", "msmpeg4", "vc1", "wmv1", "wmv2", "wmv3", "flv1", "rv30", "rv40")
#: Bits a second and channel by the family of an audio codec; all others count as LOW_BPS.
LOSSLESS, HIGH, MEDIUM = ("truehd", "mlp", "flac", "alac", "pcm_s16le", "pcm_s24le", "pcm_bluray"), ("dts", "dca"), ("ac3", "eac3")
LOSSLESS_BPS, HIGH_BPS, MEDIUM_BPS, LOW_BPS = 500_000, 250_000, 80_000, 64_000
#: Audio codecs that MP4 holds; subtitle codecs that are text, and those that MP4 can embed.
MP4_AUDIO = ("aac", "ac3", "eac3", "mp3", "alac", "mp4als")
TEXT_SUBS = ("subrip", "srt", "ass", "ssa", "mov_text", "webvtt", "text")
MP4_SUBS = (*TEXT_SUBS, "vtt")
MP4_EXTS = ("mp4", "m4v", "mov")


def codec_class(name: Column) -> Column:
    """h264, modern, legacy or other; null is other."""
    n = F.lower(F.trim(name))
    return F.when(n.isin(*H264), "h264").when(n.isin(*MODERN), "modern").when(n.isin(*LEGACY), "legacy").otherwise("other")


def codec_factor(s: Settings, pixels: Column) -> Column:
    """Share of the H.264 bitrate that the output codec needs."""
    if s.codec != "h265":
        return F.lit(1.0)
    hd, uhd, above = s.hevc
    return F.when(pixels <= PIXELS_1080P, hd).when(pixels <= PIXELS_4K, uhd).otherwise(above)


def target_kbps(s: Settings, pixels: Column, fps: Column, source_kbps: Column | None = None) -> Column:
    """The bitrate that means the tier at this size; with a source rate, never above it. Factors multiply in this order."""
    rate = F.lit(s.bpp) * pixels * F.when(fps > 0, fps).otherwise(30.0) * codec_factor(s, pixels) / 1000.0
    rate = F.greatest(F.lit(float(s.floor_kbps)), rate)
    if source_kbps is not None:
        rate = F.when(source_kbps > 0, F.least(rate, source_kbps)).otherwise(rate)
    return rate.cast("long")


def source_density(bps: Column, pixels: Column, fps: Column) -> Column:
    return F.when((pixels > 0) & (fps > 0), bps / (pixels * fps)).otherwise(0.0)


def over_target(source_kbps: Column, target: Column, tolerance: float) -> Column:
    return (target > 0) & (source_kbps > target * F.lit(tolerance))


def audio_estimate(codec: Column, channels: Column) -> Column:
    """Bits a second that a track of this codec usually takes."""
    c = F.lower(codec)
    each = F.when(c.isin(*LOSSLESS), LOSSLESS_BPS).when(c.isin(*HIGH), HIGH_BPS).when(c.isin(*MEDIUM), MEDIUM_BPS).otherwise(LOW_BPS)
    return (each * F.greatest(F.lit(1), F.coalesce(F.nullif(channels, F.lit(0)), F.lit(2)))).cast("long")


def fold(array: Column, each) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: total + each(x))


def effective_bps(bit_rate: Column, container: Column, audio_bps: Column, audio: Column) -> Column:
    """The video's own rate; else the container's without known or estimated audio; else the container's."""
    known = F.when(audio_bps != 0, audio_bps).otherwise(fold(audio, lambda a: audio_estimate(a["codec"], a["channels"])))
    rest = F.greatest(F.lit(0), container - known)
    return F.when(bit_rate != 0, bit_rate).when(container == 0, 0).when(rest == 0, container).otherwise(rest).cast("long")


def max_channels(audio: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(audio, lambda a: a["channels"])), F.lit(0))


def is_text_sub(codec: Column) -> Column:
    return F.lower(codec).isin(*TEXT_SUBS)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def human(n: Column, base: int, digits: int) -> Column:
    """(number, unit) of a byte count: scaled to the largest unit under ``base``, TB at most."""
    value, unit = n.cast("double"), F.lit("TB")
    scaled = value / float(base) ** 4
    for power, name in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        fits = value < float(base) ** (power + 1)
        scaled, unit = F.when(fits, value / float(base) ** power).otherwise(scaled), F.when(fits, name).otherwise(unit)
    return F.struct(F.bround(scaled, digits).alias("amount"), unit.alias("unit"))

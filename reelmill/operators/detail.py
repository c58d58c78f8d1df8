"""What happened to each file: one record, its one-line caption and the tags that say so in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.operators import tracks
from reelmill.settings import Settings

VERSION = "0.2"
ENCODER_NAMES = {"h264": "h264", "h265": "hevc"}


def details(plan: DataFrame, s: Settings) -> DataFrame:
    """``plan`` (with audio and subtitles) with container, reason, out_codec, video_kbps, density, audio_says and subtitles_say."""
    rows = plan.where(F.col("mode").isNotNull()).withColumn("c", tracks.container(s, F.col("ext"), F.col("audio"), F.col("subtitles"))).select("*", "c.*").drop("c")
    encoded = F.col("mode") != "remux"
    kbps = F.when(encoded, F.col("target_kbps").cast("double")).otherwise(F.col("source_kbps"))
    n, images = F.size("subtitles"), F.size(F.filter("subtitles", lambda t: ~q.is_text_sub(t["codec"])))
    number = lambda c: c.cast("string")
    in_mp4 = F.concat_ws("; ", F.when(n > images, F.concat(number(n - images), F.lit(" embedded"))), F.when(images > 0, F.concat(number(images), F.lit(" dropped"))))
    return rows.withColumns({
        "out_codec": F.when(encoded, ENCODER_NAMES[s.codec]), "video_kbps": kbps, "density": q.source_density(kbps * 1000.0, F.col("pixels"), F.col("fps")),
        "audio_says": tracks.audio_plan(s, F.col("container"), F.col("audio"))["says"],
        "subtitles_say": F.when(n == 0, "").when(F.col("container") == "mkv", F.concat(F.lit("all "), number(n))).otherwise(in_mp4),
    })


def caption() -> Column:
    """The record in one line: container first, then video, density, audio and subtitles."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    kept = F.when(F.col("reason") != "", text("kept ", F.col("container"), ": ", F.col("reason"))).otherwise(text("kept ", F.col("container")))
    codecs = F.when(F.col("out_codec").isNotNull() & (F.col("out_codec") != F.col("vcodec")), F.concat_ws("→", "vcodec", "out_codec")).otherwise(F.col("vcodec"))
    rate = F.bround("video_kbps").cast("long").cast("string")
    video = F.when(F.col("mode") == "remux", text(codecs, " copied")).when(F.col("mode") == "transcode", text(codecs, " transcoded at ", rate, " kbps")).otherwise(text(codecs, " shrunk to ", rate, " kbps"))
    return F.concat_ws(
        " · ", F.when(F.col("ext") != F.col("container"), F.concat_ws("→", "ext", "container")).otherwise(kept), video,
        F.when(F.col("density") > 0, text(F.bround(F.col("density") * 1000).cast("long").cast("string"), " millibits a pixel")),
        text("audio ", F.col("audio_says")), F.when(F.col("subtitles_say") != "", text("subtitles ", F.col("subtitles_say"))),
    )


def tags(s: Settings, day: Column, mark: str = "REELMILL") -> Column:
    """The tags written into an output; the target only where there is one."""
    fixed = {"VERSION": VERSION, "TIER": s.tier, "QUALITY": str(round(s.bpp * 1000)), "CODEC": s.codec}
    known = F.create_map(F.lit(f"{mark}_MODE"), F.col("mode"), *[F.lit(x) for k, v in fixed.items() for x in (f"{mark}_{k}", v)], F.lit(f"{mark}_DATE"), F.date_format(day, "yyyy-MM-dd"))
    target = F.create_map(F.lit(f"{mark}_TARGET_KBPS"), F.col("target_kbps").cast("string"))
    return F.when(F.col("target_kbps") > 0, F.map_concat(known, target)).otherwise(known)


#: Statistics that tools leave on a stream; they are wrong once the video is encoded anew.
STALE = ("BPS", "BPS-eng", "NUMBER_OF_BYTES", "NUMBER_OF_BYTES-eng", "NUMBER_OF_FRAMES", "NUMBER_OF_FRAMES-eng", "_STATISTICS_TAGS", "_STATISTICS_TAGS-eng", "_STATISTICS_WRITING_APP", "_STATISTICS_WRITING_APP-eng", "_STATISTICS_WRITING_DATE_UTC", "_STATISTICS_WRITING_DATE_UTC-eng")
CODEC_LABELS = {"h264": "H.264", "h265": "H.265"}


def provenance(s: Settings, day: Column, comment: Column, mark: str = "REELMILL") -> Column:
    """Arguments that write ``tags``, clear stale statistics and, where the source has no comment, say it in words."""
    pairs = F.array_sort(F.transform(F.map_entries(tags(s, day, mark)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    ours = F.flatten(F.transform(pairs, lambda t: F.array(F.lit("-metadata"), t)))
    cleared = F.array(*[F.lit(x) for name in STALE for x in ("-metadata:s:v:0", f"{name}=")])
    what = F.when(F.col("mode") == "remux", "remuxed to").otherwise(F.concat(F.col("mode"), F.lit(" to")))
    words = F.concat(F.lit(f"comment={mark.capitalize()} {VERSION} — "), what, F.lit(f" {CODEC_LABELS[s.codec]} at quality {round(s.bpp * 1000)} on "), F.date_format(day, "yyyy-MM-dd"))
    said_here = F.when(F.trim(F.coalesce(comment, F.lit(""))) == "", F.array(F.lit("-metadata"), words)).otherwise(F.array().cast("array<string>"))
    return F.concat(ours, cleared, said_here)


def said(own_tags: Column, mark: str = "REELMILL") -> Column:
    """What a file's tags say of an earlier run, in one line."""
    at = lambda k: F.element_at(own_tags, f"{mark}_{k}")
    return F.concat_ws(" · ", F.upper(at("CODEC")), F.concat(F.lit("quality "), at("QUALITY")), at("DATE"))


def cache_key(s: Settings, path: Column, size: Column, mtime: Column, start: str = "") -> Column:
    """The name under which a preview is kept: ten digits of a hash of the file, its state, the tier, the codec and the start."""
    return F.substring(F.sha1(F.concat_ws("|", path, size.cast("string"), mtime.cast("string"), F.lit(s.tier), F.lit(s.codec), F.lit(start))), 1, 10)


def preview(duration: Column, start: Column | None = None, most: float = 5.0) -> Column:
    """struct(starts, seconds) of a preview: a share of the duration from which it starts, the middle by default, never past the end."""
    seconds = F.least(F.lit(most), duration)
    share = F.lit(0.5) if start is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), start))
    return F.struct(F.greatest(F.lit(0.0), F.least(duration * share, duration - most)).alias("starts"), seconds.alias("seconds"))

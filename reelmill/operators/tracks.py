"""Container, audio and subtitle policies over track arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.operators.rules import first_of
from reelmill.settings import Settings


def listed(array: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(array)), ", ")


def container(s: Settings, ext: Column, audio: Column, subtitles: Column) -> Column:
    """struct(container, reason): MP4 unless something needs Matroska; a reason only for Matroska."""
    mkv = lambda why: F.struct(F.lit("mkv").alias("container"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    mp4 = F.struct(F.lit("mp4").alias("container"), F.lit("").alias("reason"))
    images = F.filter(subtitles, lambda t: ~q.is_text_sub(t["codec"]))
    foreign = F.filter(audio, lambda t: ~F.lower(t["codec"]).isin(*q.MP4_AUDIO))
    auto = s.container == "auto"
    if s.container == "mkv":
        return mkv("set to MKV")
    if s.keep_source_container:
        return first_of([
            (F.lit(s.keep_image_subs) & (F.size(images) > 0) & (ext != "mkv"), mkv("image subtitles need Matroska")),
            (ext.isin(*q.MP4_EXTS), mp4),
            (ext == "mkv", mkv("stays MKV")),
        ], mkv("no modern codec fits the source container"))
    if s.audio_policy == "flac":
        return mkv("FLAC needs Matroska")
    rules = [
        (F.lit(auto or s.keep_image_subs) & (F.size(images) > 0), mkv(F.concat(F.lit("image subtitles: "), listed(F.transform(images, lambda t: t["codec"]))))),
        (F.lit(auto or s.keep_mkv_for_audio) & (F.size(foreign) > 0), mkv(F.concat(F.lit("audio: "), listed(F.transform(foreign, lambda t: F.upper(t["codec"])))))),
        (F.lit(not auto and s.mkv_if_text_subs) & F.exists(subtitles, lambda t: ~F.lower(t["codec"]).isin(*q.MP4_SUBS)), mkv("a subtitle that MP4 can't embed")),
        (F.lit(s.mkv_if_tracks_over > 0) & (F.size(audio) + F.size(subtitles) > s.mkv_if_tracks_over), mkv("many tracks")),
    ]
    return first_of(rules, mp4)


def audio_plan(s: Settings, kind: Column, audio: Column) -> Column:
    """struct(codec, kbps, says): what happens to the audio in a container of this kind."""
    kbps = F.when(q.max_channels(audio) > 2, s.audio_kbps_multichannel).otherwise(s.audio_kbps_stereo)
    action = lambda codec, rate: F.struct(F.lit(codec).alias("codec"), rate.cast("int").alias("kbps"))
    none = F.lit(None)
    fixed = {"aac": action("aac", kbps), "ac3": action("ac3", kbps), "flac": action("flac", none)}
    copy = action("copy", none)
    fits = (F.size(audio) > 0) & F.forall(audio, lambda t: t["codec"].isin(*q.MP4_AUDIO))
    chosen = fixed[s.audio_policy] if s.audio_policy in fixed else F.when((kind == "mkv") | fits, copy).otherwise(fixed["aac"])
    said = F.when(F.size(audio) == 0, "no audio").when(chosen["codec"] == "copy", "copied").otherwise(
        F.concat_ws(" ", F.element_at(F.create_map(*[F.lit(x) for x in ("aac", "AAC", "ac3", "AC-3", "flac", "FLAC", "copy", "")]), chosen["codec"]), F.concat(chosen["kbps"].cast("string"), F.lit("k")))
    )
    return F.struct(chosen["codec"].alias("codec"), chosen["kbps"].alias("kbps"), said.alias("says"))


def kinds(track: Column) -> Column:
    """forced, hoh or both; normal for neither."""
    found = F.array_compact(F.array(F.when(track["forced"], "forced"), F.when(track["hearing_impaired"], "hoh")))
    return F.when(F.size(found) == 0, F.array(F.lit("normal"))).otherwise(found)


def kept_subtitles(s: Settings, subtitles: Column) -> Column:
    """Tracks of a wanted language and of a wanted kind, in order; an empty list of either wants all."""
    out = subtitles
    if s.sub_langs:
        out = F.filter(out, lambda t: F.lower(F.coalesce(t["language"], F.lit("und"))).isin(*[x.lower() for x in s.sub_langs]))
    if s.sub_kinds:
        out = F.filter(out, lambda t: F.arrays_overlap(kinds(t), F.array(*[F.lit(x.lower()) for x in s.sub_kinds])))
    return out


def sidecars(media: DataFrame, stem: Column, texts: Column) -> DataFrame:
    """One row for each text track written beside the video: stem.lang.srt, or stem.n.lang.srt where there are several."""
    exploded = media.select("*", F.size(texts).alias("tracks"), stem.alias("stem"), F.posexplode(texts).alias("nth", "track"))
    language = F.coalesce(F.col("track.language"), F.lit("und"))
    number = F.when(F.col("tracks") > 1, (F.col("nth") + 1).cast("string"))
    return exploded.withColumn("sidecar", F.concat(F.concat_ws(".", "stem", number, language), F.lit(".srt")))

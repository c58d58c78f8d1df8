"""Probe documents: nested JSON of text scalars turned into media columns."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.quality import TEXT_SUBS

STREAM = (
    "struct<index:string,codec_type:string,codec_name:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,bit_rate:string,pix_fmt:string,"
    "channels:string,tags:map<string,string>,disposition:map<string,string>>"
)
DOCUMENT = f"struct<streams:array<{STREAM}>,format:struct<bit_rate:string,duration:string,tags:map<string,string>>>"
#: A stream's figure above this share of the container's is stale.
STALE = 1.02


def whole(text: Column) -> Column:
    """Integer of a text; 0 for null and for what is no integer."""
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(0)).cast("long")


def number(text: Column) -> Column:
    n = F.trim(text).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def frame_rate(text: Column) -> Column:
    """A rate written as a fraction or a number; 0 for what is neither or divides by 0."""
    over = F.try_divide(F.trim(F.split_part(text, F.lit("/"), F.lit(1))).try_cast("double"), F.trim(F.split_part(text, F.lit("/"), F.lit(2))).try_cast("double"))
    return F.when(F.contains(text, F.lit("/")), F.coalesce(over, F.lit(0.0))).otherwise(number(text))


def tags_of(tags: Column) -> Column:
    return F.coalesce(F.transform_keys(tags, lambda k, _: F.upper(k)), F.create_map().cast("map<string,string>"))


def stream_bps(stream: Column, duration: Column) -> Column:
    """A stream's rate: reported, or from its byte count, or from its rate tag."""
    tags = tags_of(stream["tags"])
    counted = F.when(duration > 0, (whole(tags["NUMBER_OF_BYTES"]) * 8 / duration).cast("long"))
    return F.coalesce(F.nullif(whole(stream["bit_rate"]), F.lit(0)), F.nullif(counted, F.lit(0)), whole(tags["BPS"]))


def sane(bps: Column, container: Column) -> Column:
    return F.when((bps > 0) & (container > 0) & (bps > container * STALE), 0).otherwise(bps).cast("long")


def normalised(probes: DataFrame, doc_col: str = "document", mark: str = "REELMILL") -> DataFrame:
    """``probes`` with the media columns of each JSON document; ``ok`` is false and the rest empty for broken ones."""
    d = F.from_json(doc_col, DOCUMENT)
    rows = probes.withColumn("d", d).withColumn("ok", F.col("d.streams").isNotNull())
    of = lambda kind: F.filter(F.coalesce("d.streams", F.array().cast(f"array<{STREAM}>")), lambda s: s["codec_type"] == kind)
    moving = F.filter(of("video"), lambda s: ~F.coalesce(whole(s["disposition"]["attached_pic"]) != 0, F.lit(False)))
    flag = lambda s, k: F.coalesce(whole(s["disposition"][k]) != 0, F.lit(False))
    rows = rows.withColumns({
        "video": F.get(moving, F.lit(0)), "duration": number(F.col("d.format.duration")), "container_bit_rate": whole(F.col("d.format.bit_rate")),
        "file_tags": tags_of(F.col("d.format.tags")),
    })
    audio_sum = F.aggregate(of("audio"), F.lit(0).cast("long"), lambda t, s: t + stream_bps(s, F.col("duration")))
    average = frame_rate(F.col("video.avg_frame_rate"))
    codec = lambda s: F.lower(F.coalesce(s["codec_name"], F.lit("")))
    language = lambda s: F.coalesce(tags_of(s["tags"])["LANGUAGE"], F.lit("und"))
    return rows.withColumns({
        "vcodec": F.col("video.codec_name"), "pix_fmt": F.col("video.pix_fmt"),
        "width": whole(F.col("video.width")).cast("int"), "height": whole(F.col("video.height")).cast("int"),
        "fps": F.coalesce(F.nullif(average, F.lit(0.0)), frame_rate(F.col("video.r_frame_rate")), F.lit(0.0)),
        "bit_rate": F.coalesce(sane(stream_bps(F.col("video"), F.col("duration")), F.col("container_bit_rate")), F.lit(0)).cast("long"),
        "audio_bps": sane(audio_sum, F.col("container_bit_rate")),
        "audio": F.transform(of("audio"), lambda s: F.struct(whole(s["index"]).cast("int").alias("index"), codec(s).alias("codec"), F.coalesce(F.nullif(whole(s["channels"]), F.lit(0)), F.lit(2)).cast("int").alias("channels"), language(s).alias("language"))),
        "subtitles": F.transform(of("subtitle"), lambda s: F.struct(whole(s["index"]).cast("int").alias("index"), codec(s).alias("codec"), codec(s).isin(*TEXT_SUBS).alias("is_text"), language(s).alias("language"), flag(s, "forced").alias("forced"), flag(s, "hearing_impaired").alias("hearing_impaired"), flag(s, "default").alias("default"))),
        "comment": F.coalesce(F.col("file_tags")["COMMENT"], F.lit("")), "own_tags": F.map_filter("file_tags", lambda k, _: F.startswith(k, F.lit(f"{mark}_"))),
        "pixels": whole(F.col("video.width")) * whole(F.col("video.height")),
    }).drop("d", "video", "file_tags")


def run_tool(path: str, tool: str = "ffprobe", seconds: int = 120) -> str:
    """The tool's JSON for one file; a document of the error where it fails."""
    command = [tool, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=True)
        return done.stdout
    except (OSError, subprocess.SubprocessError) as e:
        return json.dumps({"error": str(e)})


def probed(scan: DataFrame, probe: Callable[[str], str] = run_tool, workers: int | None = None, pool: int = 12) -> DataFrame:
    """``scan`` with ``document``: the probe's JSON of each path. Filter before: nothing is pushed through a probe.

    Each task runs up to ``pool`` probes at once, as they mostly wait; a probe that raises leaves its row out.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> str | None:
            try:
                return probe(path)
            except Exception:  # noqa: BLE001 - any probe may be passed
                return None

        for rows in batches:
            with ThreadPoolExecutor(max_workers=max(1, min(pool, len(rows)))) as threads:
                found = rows.assign(document=list(threads.map(one, rows["path"])))
            yield found[found["document"].notna()]

    spread = scan.repartition(workers) if workers else scan
    return spread.mapInPandas(each, scan.withColumn("document", F.lit("")).schema)

"""Media records derived from the order tables: the library that the catalogue's queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.settings import VIDEO_EXTS, Settings

CODECS = ("h264",) * 6 + ("hevc", "av1", "vp9", "mpeg2video", "mpeg4", "prores")
SIZES = ((640, 360), (1280, 720), (1920, 1080), (2560, 1440), (3840, 2160), (7680, 4320))
AUDIO = ("aac", "ac3", "dts", "truehd", "opus", "flac")
SUBTITLES = ("subrip", "ass", "hdmv_pgs_subtitle", "dvd_subtitle")
LANGUAGES = ("eng", "fre", "spa", "und")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a media file, without its tracks."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    bps = lambda times: F.floor(F.lit(float(times)) * F.col("o_totalprice")).cast("long")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("file_id"), cust.alias("name_id"), "o_orderstatus", "o_orderdate",
        pick(VIDEO_EXTS, cust).alias("ext"), pick(CODECS, 7 * key + cust).alias("vcodec"),
        pick(tuple(w for w, _ in SIZES), key).alias("width"), pick(tuple(h for _, h in SIZES), key).alias("height"),
        pick((24000 / 1001, 25.0, 30.0, 60.0, 0.0), key).alias("fps"),
        F.when(key % 4 == 0, 0).otherwise(bps(60)).cast("long").alias("bit_rate"), bps(66).alias("container_bit_rate"), F.lit(0).cast("long").alias("audio_bps"),
        (F.lit(60.0) + (37 * cust + key) % 7200).alias("duration"),
        ((F.col("o_orderstatus") == "P") & (key % 2 == 0)).alias("own_work"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
    )
    return rows.withColumns({
        "pixels": F.col("width").cast("long") * F.col("height"),
        "path": F.concat(F.lit("/lib/d"), F.col("file_id").cast("string"), F.lit("/t"), F.col("name_id").cast("string"), F.lit("."), F.col("ext")),
        "name": F.concat(F.lit("t"), F.col("name_id").cast("string"), F.lit("."), F.col("ext")),
        "size": F.floor(F.col("container_bit_rate") / 8.0 * F.col("duration")).cast("long"),
    })


def lines(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)


def audio_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "A").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("index"), "l_partkey", "l_suppkey", pick(AUDIO, F.col("l_partkey")).alias("codec"), pick((2, 6, 8), F.col("l_suppkey")).alias("channels")
    )


def subtitle_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, "N").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("index"), "l_partkey", "l_suppkey", pick(SUBTITLES, F.col("l_partkey")).alias("codec"),
        pick(LANGUAGES, F.col("l_linenumber")).alias("language"), (F.col("l_discount") >= 0.08).alias("forced"), (F.col("l_tax") >= 0.07).alias("hearing_impaired"),
    )


def as_array(tracks: DataFrame, name: str) -> DataFrame:
    """The tracks of each file, in order of index, part and supplier; a file has a dozen at most."""
    fields = [c for c in tracks.columns if c not in ("file_id", "index", "l_partkey", "l_suppkey")]
    each = F.struct("index", "l_partkey", "l_suppkey", *fields)
    kept = lambda x: F.struct(x["index"].alias("index"), *[x[f].alias(f) for f in fields])
    return tracks.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(each)), kept).alias(name))


def library(spark: SparkSession, sf_dir: str, subtitles: bool = False) -> DataFrame:
    """Media files with their audio (and subtitle) arrays; files without tracks have empty ones."""
    found = files(spark, sf_dir)
    sides = [("audio", audio_tracks)] + [("subtitles", subtitle_tracks)] * subtitles
    for name, tracks in sides:
        side = as_array(tracks(spark, sf_dir), name)
        found = found.join(side, "file_id", "left")
        found = found.withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return found


def ledger(spark: SparkSession, sf_dir: str, s: Settings) -> DataFrame:
    """What earlier runs have recorded: files of finished orders, a third of them under other settings."""
    done = files(spark, sf_dir).where(F.col("o_orderstatus") == "F")
    return done.select(F.when(F.col("file_id") % 3 == 0, F.lit("GOOD|h264|rmx1|xc1|inplace")).otherwise(F.lit(s.signature())).alias("signature"), "path", "size", "mtime")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of runs: one row a processed file, a run for each user."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "shrink").when(kind == "click", "transcode").when(kind == "view", "remux").when(kind == "signup", "skip-at-tier").otherwise("error")
    src = F.floor(F.col("value") * 1e6).cast("long")
    level = F.when(F.col("event_id") % 7 == 0, "WARN").when(F.col("event_id") % 5 == 0, "NOTE")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run"), outcome.alias("outcome"), src.alias("src_bytes"), level.alias("level"))
    out = F.floor(F.col("src_bytes") * (F.col("event_id") % 10 + 1) / 10.0).cast("long")
    note = F.array(F.struct(F.col("level").alias("level"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("message")))
    return rows.select("event_id", "ts", "run", F.concat(F.lit("/lib/e"), F.col("event_id").cast("string")).alias("path"), "outcome", "src_bytes", out.alias("out_bytes"),
        F.when(F.col("level").isNotNull(), note).otherwise(F.array().cast("array<struct<level:string,message:string>>")).alias("notes"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan entries named after documents: the name is the first words of the text."""
    ext = F.when(F.col("lang") == "en", "mkv").when(F.col("lang") == "de", "avi").when(F.col("lang") == "fr", "mp4").otherwise("ts")
    name = F.concat(F.regexp_replace(F.substring(F.split("text", "\n")[0], 1, 40), "[/.]", " "), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), (F.col("n_chars") * 1000).alias("size"), 
        F.when(F.col("doc_id") % 3 == 0, "Reelmill shrink to h265").when(F.col("doc_id") % 3 == 1, "reelmill remux").otherwise(F.col("text")).alias("comment"))

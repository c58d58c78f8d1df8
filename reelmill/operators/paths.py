"""Where outputs, originals and sidecars go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.names import base_name, stem
from reelmill.settings import Settings


def output_path(s: Settings, path: Column, kind: Column) -> Column:
    """The produced file: beside the source, or in the output folder, flat or as the source's tree."""
    plain = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    if s.output_mode == "separate":
        inner = stem(base_name(path)) if s.output_flat else F.substring(plain, len(s.src) + 2, 1 << 30)
        plain = F.concat(F.lit(f"{s.output_dir}/"), inner)
    return F.concat(plain, F.lit("."), kind)


def archive_folder(s: Settings, path: Column) -> Column:
    """The archive folder of an original: the archive and the source's own folder below the library."""
    inner = F.substring(F.regexp_replace(path, r"/[^/]*$", ""), len(s.src) + 2, 1 << 30)
    return F.when(inner == "", F.lit(s.archive)).otherwise(F.concat(F.lit(f"{s.archive}/"), inner))


def collisions(media: DataFrame, out: str, order: str, ok: str | None = None) -> DataFrame:
    """``media`` with ``writes``: whether it claims its output path, in scan order. Others find it taken.

    With ``ok`` (whether a file's work succeeded) the path is free until the first success.
    """
    if ok is None:
        return media.withColumn("writes", F.row_number().over(Window.partitionBy(out).orderBy(order)) == 1)
    before = Window.partitionBy(out).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return media.withColumn("writes", ~F.coalesce(F.bool_or(ok).over(before), F.lit(False)))


def existing(plan: DataFrame, listing: DataFrame, out: str) -> DataFrame:
    """``plan`` with outcome skip-existing, and no mode, where another file's output is there already.

    ``listing`` has the paths that exist. A remux of a file onto itself is skip-modern; an encode onto itself goes on.
    """
    there = listing.select(F.col("path").alias("there")).distinct()
    rows = plan.join(there, F.col(out) == F.col("there"), "left")
    found = F.col("mode").isNotNull() & F.col("there").isNotNull() & (F.col(out) != F.col("path"))
    same = (F.col("mode") == "remux") & (F.col(out) == F.col("path"))
    outcome = F.when(same, "skip-modern").when(found, "skip-existing").otherwise(F.col("outcome"))
    return rows.withColumns({"outcome": outcome, "mode": F.when(~F.coalesce(found | same, F.lit(False)), F.col("mode"))}).drop("there")


def size_gate(mode: Column, src: Column, out: Column, ratio: float) -> Column:
    """Whether an encode is thrown away: a shrink that saves too little, a transcode that grew by more than half a percent."""
    return F.when(mode == "shrink", out >= src * F.lit(ratio)).when(mode == "transcode", out > src * F.lit(1.005)).otherwise(False)


def validity(ok: Column, vcodec: Column, out_duration: Column, src_duration: Column) -> Column:
    """Whether an output can stand in for its source: readable video of a duration that is not cut short."""
    short = (src_duration > 1) & (out_duration < src_duration * 0.95)
    return ok & (F.coalesce(vcodec, F.lit("")) != "") & (out_duration > 0) & ~short


def fate(s: Settings, out: Column, src: Column, dropped: Column) -> Column:
    """What becomes of an original: archived-first, archived, overwritten, deleted or kept."""
    over, lost = out == src, dropped != ""
    keep = F.lit(s.source_action == "archive") | lost
    case = F.when(over & keep, "archived-first")
    if s.source_action == "archive":
        return case.otherwise(F.lit("archived"))
    if s.source_action == "delete":
        return case.when(lost, "archived").when(~over, "deleted").otherwise("overwritten")
    return case.when(over, "overwritten").otherwise("kept")

"""A whole run over a library: what the ledger holds is passed over, the rest encoded, checked, put in its place and recorded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import quality as q
from reelmill.operators import detail, execute, history, paths, placement, tracks, volumes
from reelmill.plans.library import planned
from reelmill.settings import Settings
from reelmill.sources import probe
from reelmill.tables import kept, removed

RESULT = ["path", "outcome", "src_bytes", "out_bytes", "notes"]
NOTES = "array<struct<level:string,message:string>>"


@dataclass(frozen=True)
class Places:
    """Folders of a run that the driver and all executors share, and the volumes that it must wait for."""

    stage: str
    journal: str
    ledger: str
    progress: str = ""
    stop: str = ""
    volumes: tuple[str, ...] = ()


def notes(*each: tuple[Column, str, Column]) -> Column:
    """The notes (level, message) whose condition holds."""
    made = [F.when(cond, F.struct(F.lit(level).alias("level"), message.alias("message"))) for cond, level, message in each]
    return F.array_compact(F.array(*made)).cast(NOTES)


def jobs_of(media: DataFrame, s: Settings, encoder: str | None = None, day: Column | None = None) -> DataFrame:
    """``media`` decided, with container, out_path, attempts, lost (what the container can't hold) and fate of each file with a mode."""
    rows = planned(media, s).withColumn("c", tracks.container(s, F.col("ext"), F.col("audio"), F.col("subtitles"))).select("*", "c.container").drop("c")
    images = F.size(F.filter("subtitles", lambda t: ~q.is_text_sub(t["codec"])))
    rows = rows.withColumns({"out_path": paths.output_path(s, F.col("path"), F.col("container")), "lost": F.when((F.col("container") == "mp4") & (images > 0), "image tracks").otherwise("")})
    tags = detail.provenance(s, F.current_date() if day is None else day, F.col("comment"))
    video, audio = execute.video_arguments(s, encoder, F.lit(False)), execute.audio_arguments(s, F.col("container"), F.col("audio"))
    found = execute.attempts(F.col("container"), video, audio, F.col("subtitles"), tracks.kept_subtitles(s, F.col("subtitles")), tags)
    archive = paths.archive_folder(s, F.col("path"))
    return rows.withColumns({"attempts": found, "fate": paths.fate(s, F.col("out_path"), F.col("path"), F.col("lost")), "archive": archive})


def checked(done: DataFrame, plan: DataFrame, s: Settings, look: Callable[[str], str]) -> DataFrame:
    """``plan`` with what its encodes came to: encoded, staged, out_bytes, error, and ``outcome`` after a probe of each output and the size gate."""
    seen = probe.normalised(probe.probed(done.where("ok").select(F.col("staged").alias("path")), look))
    seen = seen.select(F.col("path").alias("staged"), F.col("ok").alias("readable"), F.col("vcodec").alias("out_vcodec"), F.col("duration").alias("out_duration"))
    both = plan.join(done.select("path", F.col("ok").alias("encoded"), "staged", "out_bytes", "error"), "path").join(seen, "staged", "left")
    valid = paths.validity(F.coalesce("readable", F.lit(False)), F.col("out_vcodec"), F.coalesce("out_duration", F.lit(0.0)), F.col("duration"))
    small = paths.size_gate(F.col("mode"), F.col("size"), F.col("out_bytes"), s.min_saving_ratio)
    outcome = F.when(~F.col("encoded") | ~valid, "error").when(small, "skip-min-saving").otherwise(F.col("mode"))
    why = F.when(~F.col("encoded"), F.col("error")).otherwise("the output can't stand in for its source")
    return both.withColumns({"outcome": outcome, "notes": notes((outcome == "error", "ERROR", why), ((outcome == F.col("mode")) & (F.col("lost") != ""), "WARN", F.concat(F.lit("original kept: "), F.col("lost"))))})


def run(
    media: DataFrame, s: Settings, places: Places, encode=execute.tool, look: Callable[[str], str] = probe.run_tool, listing: DataFrame | None = None, encoder: str | None = None,
    ask: Callable[[str], bool] = volumes.responds, every: float = volumes.EVERY,
) -> DataFrame:
    """(path, outcome, src_bytes, out_bytes, notes) of every file of ``media`` (probed, with distinct paths); ``listing`` has the paths that exist.

    Commits that an earlier driver left are finished first. Files that the ledger holds under these settings are not
    looked at again. Each file whose output path is free is encoded into the stage, in rounds while its volumes answer;
    outputs are probed, held against their sources and the size gate; then outputs, originals and ledger lines are
    committed together. So a run that is lost at any point can be begun again and does only what is left.
    """
    spark = media.sparkSession
    placement.recovered(places.journal)
    keyed = history.keyed(media, s)
    ledger = history.read_ledger(spark, places.ledger) if history_there(spark, places.ledger) else spark.createDataFrame([], history.LEDGER_DDL)
    again = kept(history.resumed(keyed, ledger, s).select("path", "size"), "resumed")
    plan = jobs_of(history.pending(keyed, ledger, s), s, encoder)
    if listing is not None:
        plan = paths.existing(plan, listing, "out_path")
    taken = paths.collisions(plan.where("mode is not null").select("path", "out_path"), "out_path", "path").where("not writes").select("path")
    plan = kept(plan.join(taken.withColumn("late", F.lit(True)), "path", "left"), "plan")
    late = F.coalesce("late", F.lit(False))
    jobs = plan.where(F.col("mode").isNotNull() & ~late)
    encoding = lambda df: execute.executed(df, places.stage, encode, stop=places.stop, progress=places.progress)
    rounds = [done for done, _ in volumes.in_rounds(jobs.select("path", "out_path", "attempts"), encoding, list(places.volumes), ask, volumes.marker(places.stop), every)]
    done = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], execute.RESULT)
    worked = checked(done, jobs, s, look)
    left = plan.where(F.col("mode").isNull() | late).withColumns({
        "outcome": F.when(late, "skip-existing").otherwise(F.col("outcome")), "staged": F.lit(None).cast("string"), "out_bytes": F.lit(0).cast("long"), "notes": notes(),
    })
    columns = ["signature", "path", "size", "mtime", "outcome", "staged", "out_path", "out_bytes", "fate", "archive", "notes", *(["ok"] if "ok" in media.columns else [])]
    own = [c for c in columns if c != "ok"]
    probed = (lambda df: df.withColumn("probed", F.coalesce("ok", F.lit(True)) if "ok" in media.columns else F.lit(True)))
    results = kept(probed(left).select(*own, "probed").unionByName(worked.withColumn("probed", F.lit(True)).select(*own, "probed")), "outcomes")
    changes = F.col("outcome") == F.coalesce("changed_to", F.lit(""))
    line = history.ledger_line(*[F.col(c) for c in history.KEY])
    recorded = history.recorded(results).select("path", line.alias("ledger"))
    rows = results.join(recorded, "path", "left").withColumn("changed_to", F.when(F.col("outcome").isin("shrink", "transcode", "remux"), F.col("outcome")))
    placed = rows.select("path", F.when(changes, F.col("staged")).alias("staged"), "out_path", F.when(changes, F.col("fate")).otherwise("kept").alias("fate"), "archive", F.when(F.lit(s.ledger_enabled), F.col("ledger")).alias("ledger"))
    placement.place(placed.where(F.col("staged").isNotNull() | F.col("ledger").isNotNull()), places.journal, places.ledger)
    removed(spark, places.stage)
    failed = placement.placed(spark, places.journal).where("error != ''").select("path", F.col("error").alias("not_placed")) if history_there(spark, f"{places.journal}/placed") else spark.createDataFrame([], "path string, not_placed string")
    lost = F.col("not_placed").isNotNull()
    told = results.join(failed.dropDuplicates(["path"]), "path", "left").withColumns({
        "notes": F.when(lost, F.concat("notes", notes((lost, "ERROR", F.col("not_placed"))))).otherwise(F.col("notes")), "outcome": F.when(lost, "error").otherwise(F.col("outcome")),
    })
    skipped = again.select("path", F.lit("resume").alias("outcome"), F.col("size").alias("src_bytes"), F.lit(0).cast("long").alias("out_bytes"), notes().alias("notes"))
    return kept(told.withColumn("src_bytes", F.col("size")).select(*RESULT).unionByName(skipped.select(*RESULT)), "results")


def history_there(spark, path: str) -> bool:
    """Whether a folder is there that Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

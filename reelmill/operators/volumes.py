"""Volumes that a run reads and writes: each is asked by itself, and jobs are dealt where both of theirs answer."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.tables import kept

ANSWER = "volume string, answers boolean, at long"
EVENT = "at long, event string, path string"
#: Fixed values, in seconds: how long a volume may take to answer, how often it is asked, and how long an answer holds.
PATIENCE, EVERY, FRESH = 5.0, 2.0, 3.0


def marker(path: str) -> Callable[[], bool]:
    """Whether the marker file is there by now; no path, no marker."""
    return lambda: bool(path) and os.path.exists(path)


def responds(volume: str, seconds: float = PATIENCE) -> bool:
    """Whether a tool of its own process can look at the volume in time; one that hangs on a dead mount is left behind."""
    asking = subprocess.Popen(["stat", volume], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        return asking.wait(seconds) == 0
    except subprocess.TimeoutExpired:
        asking.kill()
        return False


def volume_of(path: Column, volumes: list[str]) -> Column:
    """The volume that a path lies on: the longest that it begins with; the empty text where there is none."""
    own = [F.when((path == v) | F.startswith(path, F.lit(f"{v.rstrip('/')}/")), F.lit(v)) for v in sorted(volumes, key=len, reverse=True)]
    return F.coalesce(*own, F.lit(""))


def asked(spark: SparkSession, volumes: list[str], ask: Callable[[str], bool] = responds) -> DataFrame:
    """(volume, answers, at) now, a task for each of the volumes (those of the settings: a handful)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(answers=[bool(ask(v)) for v in rows["volume"]], at=time.time_ns() // 1_000_000)

    one_each = spark.createDataFrame([(v,) for v in volumes], "volume string").repartition(max(1, len(volumes)))
    return one_each.mapInPandas(each, ANSWER)


def answering(answers: DataFrame, now: int, fresh: float = FRESH) -> DataFrame:
    """The volumes whose last answer was yes and is not older than ``fresh`` seconds."""
    last = answers.groupBy("volume").agg(F.max_by("answers", "at").alias("answers"), F.max("at").alias("at"))
    return last.where(F.col("answers") & (F.col("at") >= now - int(fresh * 1000))).select("volume")


def edges(answers: DataFrame) -> DataFrame:
    """(at, event, path) of a history of answers: "stuck" when a volume first fails, "back" when it answers again; nothing in between."""
    before = F.coalesce(F.lag("answers").over(Window.partitionBy("volume").orderBy("at")), F.lit(True))
    turned = answers.withColumn("before", before).where(F.col("answers") != F.col("before"))
    return turned.select("at", F.when(F.col("answers"), "back").otherwise("stuck").alias("event"), F.col("volume").alias("path"))


def stuck_now(events: DataFrame) -> DataFrame:
    """The paths whose last event is "stuck" and since when (a stream: output mode complete)."""
    last = events.groupBy("path").agg(F.max_by("event", "at").alias("event"), F.max("at").alias("since"))
    return last.where("event = 'stuck'").select("path", "since")


def ready(jobs: DataFrame, up: DataFrame, volumes: list[str]) -> DataFrame:
    """The jobs (path, out_path, ...) whose source and target lie on volumes that are up, or on none of the list."""
    hosts = up.unionByName(up.sparkSession.createDataFrame([("",)], "volume string"))
    for side in ("path", "out_path"):
        jobs = jobs.join(F.broadcast(hosts), volume_of(F.col(side), volumes) == hosts.volume, "left_semi")  # a row a volume
    return jobs


def in_rounds(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], volumes: list[str], ask: Callable[[str], bool] = responds, stopped: Callable[[], bool] = marker(""), every: float = EVERY) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Run jobs (with distinct paths) in rounds: (results, answers so far) after each, until all have had their turn or the run is stopped.

    Every round asks each volume once and deals the jobs whose volumes answer; the others wait for the next
    round, so no task sits on a dead mount and no file is lost to one. ``run`` gives a row with the ``path`` of each job
    that is done. A round's results and the answers are tables, and only counts come to the driver.
    """
    spark, history = jobs.sparkSession, None
    left = kept(jobs, "jobs")
    while not left.isEmpty() and not stopped():
        said = kept(asked(spark, volumes, ask), "answers")
        history = said if history is None else history.unionByName(said)
        up = answering(said, said.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0])
        done = kept(run(ready(left, up, volumes)), "results")
        tried = done.select("path")
        yield done, history
        waiting = kept(left.join(tried, "path", "left_anti"), "jobs")
        if waiting.count() == left.count():
            time.sleep(every)
        left = waiting

"""Runs as they go: result files as a stream, the running summary and the running estimate."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from reelmill.operators import execute, progress, report
from reelmill.operators.predict import HEAVY_SECONDS, SKIP_SECONDS
from reelmill.plans import library as plans


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, only: str = "*") -> DataFrame:
    """Result files as they appear in a folder; so many a batch, as results are published in batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", only).parquet(path)


def running_summary(results: DataFrame) -> DataFrame:
    """Files and bytes of each outcome so far (output mode complete)."""
    return results.groupBy("outcome").agg(F.count("*").alias("files"), F.sum(report.saved_bytes()).alias("saved"))


def running_eta(results: DataFrame) -> DataFrame:
    """(run, done, spent_heavy, spent_light, rate, light_rate) after each batch of (run, predicted_s, real_s)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, predicted, heavy, light, n_light = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0)
        for rows in batches:
            big = rows["predicted_s"] >= HEAVY_SECONDS
            done += len(rows)
            predicted += float(rows.loc[big, "predicted_s"].sum())
            heavy += float(rows.loc[big, "real_s"].sum())
            light += float(rows.loc[~big, "real_s"].sum())
            n_light += int((~big).sum())
        state.update((done, predicted, heavy, light, n_light))
        rate = min(5.0, max(0.2, heavy / predicted)) if predicted > 30 else 1.0
        yield pd.DataFrame({"run": [key[0]], "done": [done], "spent_heavy": [heavy], "spent_light": [light], "rate": [rate], "light_rate": [light / n_light if n_light > 20 else SKIP_SECONDS]})

    return results.groupBy("run").applyInPandasWithState(
        step, "run long, done long, spent_heavy double, spent_light double, rate double, light_rate double",
        "done long, predicted double, heavy double, light double, n_light long", "update", GroupStateTimeout.NoTimeout,
    )


def running_estimate(plan: DataFrame, total_files: int | None = None) -> DataFrame:
    """The estimate over the files probed so far (output mode complete), scaled up to all until all are probed."""
    return plans.estimate(plan, total_files)


def field(line: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(line, rf"^{name}=\s*(\S.*)$", 1), F.lit(""))


def told(line: Column, duration_s: Column) -> Column:
    """struct(fps, bitrate, speed, fraction) that a line of encoder progress tells; null where it doesn't."""
    return F.struct(*[field(F.trim(line), n).alias(n) for n in ("fps", "bitrate", "speed")], fraction(line, duration_s).alias("fraction"))


def fraction(line: Column, duration_s: Column) -> Column:
    """The share done that a line of encoder progress tells, from 0 to 1; null for other lines."""
    at = F.nullif(F.regexp_extract(line, r"out_time_ms=(\d+)", 1), F.lit("")).try_cast("double") / 1e6
    return F.when((duration_s > 0) & at.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / duration_s)))


def reports(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(label, seq, at_s, line) that running encodes tell in a folder, as they come."""
    return spark.readStream.schema(execute.REPORT).option("maxFilesPerTrigger", files_per_batch).json(folder)


class Throttle(StatefulProcessor):
    """Keeps of each label the time and share of the last report shown, and shows those that move on from it.

    With ``hold`` a report that isn't shown is kept as well, and a timer shows the last one held ``hold`` seconds later if none
    followed that was.
    """

    def __init__(self, step: float, wait: float, hold: float | None):
        self.step, self.wait, self.hold = step, wait, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_s double, fraction double")
        self.held = handle.getValueState("held", "seq long, at_s double, fraction double") if self.hold is not None else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, seen = self.last.get() if self.last.exists() else (None, None)
        waiting, out = self.held.get() if self.held is not None and self.held.exists() else None, []
        for seq, at, share in sorted((r for b in rows for r in zip(b["seq"], b["at_s"], b["fraction"])), key=lambda r: r[0]):
            share = None if pd.isna(share) else float(share)
            if progress.moves_on(share, float(at), seen, last, self.step, self.wait):
                out.append((key[0], int(seq), float(at), share))
                last, seen, waiting = float(at), share, None
            else:
                waiting = int(seq), float(at), share
        if out:
            self.last.update((last, seen))
        if self.held is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if waiting:
                self.held.update(waiting)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.hold * 1000))
            else:
                self.held.clear()
        yield pd.DataFrame(out, columns=REPORTED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.held is not None and self.held.exists():
            seq, at, share = self.held.get()
            out.append((key[0], seq, at, share))
            self.last.update((at, share))
            self.held.clear()
        yield pd.DataFrame(out, columns=REPORTED)

    def close(self) -> None:
        pass


REPORTED = ["label", "seq", "at_s", "fraction"]


def throttled(rows: DataFrame, step: float = progress.STEP, wait: float = progress.WAIT, hold: float | None = None) -> DataFrame:
    """``progress.shown`` of a stream of (label, seq, at_s, fraction), whose batches follow each label's order.

    State of a label is two numbers (and with ``hold`` the last report not shown). Needs the RocksDB state store
    (``with_rocks``). A restart from its checkpoint goes on where it was.
    """
    return rows.select(*REPORTED).groupBy("label").transformWithStateInPandas(
        Throttle(step, wait, hold), "label string, seq long, at_s double, fraction double", "Append", "None" if hold is None else "ProcessingTime"
    )


def with_rocks(spark: SparkSession) -> None:
    """Let the session's streams keep state as values and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Published(SimpleDataSourceStreamReader):
    """JSON rows of a folder's files in the order of their names, ``rows`` a batch: the offset is a file's name and a row's number in it.

    Files appear whole, and names grow with time. The rows of one batch pass through the driver: there are few by design.
    """

    def __init__(self, folder: str, rows: int, names: list[str]):
        self.folder, self.rows, self.names = folder, rows, names

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "row": 0}

    def lines(self, start: dict) -> Iterator[tuple[str, int, tuple]]:
        for name in sorted(n for n in os.listdir(self.folder) if n.endswith(".json") and n >= start["file"]):
            with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                for i, line in enumerate(f):
                    if name > start["file"] or i >= start["row"]:
                        r = json.loads(line)
                        yield name, i + 1, tuple(r.get(c) for c in self.names)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = list(islice(self.lines(start), self.rows))
        return iter([r for *_, r in found]), {"file": found[-1][0], "row": found[-1][1]} if found else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for name, row, r in self.lines(start):
            if (name, row) > (end["file"], end["row"]):
                return
            yield r


class Publishing(DataSource):
    """Streaming source ``reelmill_published``: options ``folder`` and ``rows`` (25), and the schema that the caller gives."""

    @classmethod
    def name(cls) -> str:
        return "reelmill_published"

    def simpleStreamReader(self, schema) -> Published:  # noqa: N802
        return Published(self.options["folder"], int(self.options.get("rows", "25")), [f.name for f in schema.fields])


def published(spark: SparkSession, folder: str, schema: str, rows: int = 25) -> DataFrame:
    """What a scan has found so far, in batches of ``rows`` rows, whatever files they come in."""
    spark.dataSource.register(Publishing)
    return spark.readStream.format(Publishing.name()).schema(schema).option("folder", folder).option("rows", rows).load()


class Edges(StreamingQueryListener):
    """Tells "stuck" and "back" once each, from the stuck volumes that a query observes (``watched``) batch by batch."""

    def __init__(self, tell: Callable[[str, str], None]):
        self.tell, self.known = tell, set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get("volumes")
        if row is None:
            return
        for _, path, stuck in sorted(tuple(x) for x in row["changes"] or []):
            if stuck and path not in self.known:
                self.known.add(path)
                self.tell("stuck", path)
            elif not stuck and path in self.known:
                self.known.discard(path)
                self.tell("back", path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def watched(answers: DataFrame) -> DataFrame:
    """A stream of ``volumes.ANSWER`` rows that tells a listener what each batch says of its volumes: a few, asked every two seconds."""
    return answers.observe("volumes", F.collect_set(F.struct("at", F.col("volume").alias("path"), (~F.col("answers")).alias("stuck"))).alias("changes"))


def drained(query_source: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there; each batch's rows are a table of their own below ``folder``, with ``batch``."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    started = query_source.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    spark = query_source.sparkSession
    schema = StructType([*query_source.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{folder}/rows") if started.lastProgress is not None else spark.createDataFrame([], schema)


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of the batches of a drained stream the last row of each key, or the last batch where there is none."""
    if not key:
        return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")

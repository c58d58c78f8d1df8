"""Remaining time of a run, and which progress reports are shown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.operators.predict import HEAVY_SECONDS, SKIP_SECONDS
from reelmill.operators.running import with_running


def eta(heavy_left: Column, light_left: Column, heavy_predicted: Column, heavy_real: Column, light_real: Column, light_done: Column) -> Column:
    """Seconds left: heavy work at the rate that it has really cost so far, light files at their measured cost."""
    rate = F.when(heavy_predicted > 30, heavy_real / heavy_predicted).otherwise(1.0)
    light = F.when(light_done > 20, light_real / light_done).otherwise(SKIP_SECONDS)
    return F.greatest(F.lit(0.0), heavy_left * F.greatest(F.lit(0.2), F.least(F.lit(5.0), rate)) + light_left * light)


def trace(events: DataFrame, run: str, order: list[str], seconds: str, real: str, parts: int | None = None) -> DataFrame:
    """``events`` with the estimate after each: running sums of predicted and real seconds within a run, however long it is."""
    heavy, given = F.col(seconds) >= HEAVY_SECONDS, lambda cond, c: F.when(cond, F.col(c)).otherwise(0.0)
    sums = {"planned": given(heavy, seconds), "spent": given(heavy, real), "light": given(~heavy, real), "done": (~heavy).cast("long")}
    rows = with_running(events, order, {f"eta_{n}": c for n, c in sums.items()}, [run], parts=parts)
    planned, spent, light, done = (F.col(f"eta_{n}") for n in sums)
    return rows.withColumn("eta", eta(F.col("eta_planned_all") - planned, F.col("eta_done_all") - done, planned, spent, light, done)).select(*events.columns, "eta")


def gaps(events: DataFrame, run: str, order: list[str], at: str, parts: int | None = None) -> DataFrame:
    """``events`` with ``gap_us``: microseconds since the one before in its run, 0 for the first."""
    rows = with_running(events, order, {}, [run], {"before_at": F.col(at)}, parts)
    gap = F.coalesce(F.expr(f"timestampdiff(MICROSECOND, before_at, {at})"), F.lit(0).cast("long"))
    return rows.withColumn("gap_us", F.greatest(F.lit(0).cast("long"), gap)).drop("before_at")


#: The share and the seconds by which a report must have moved on to be shown.
STEP, WAIT = 0.01, 1.5


def moves_on(fraction: float | None, at: float, seen: float | None, last: float | None, step: float = STEP, wait: float = WAIT) -> bool:
    """Whether a report is shown after the last one shown: it has moved, is late enough, or either share isn't known."""
    return last is None or fraction is None or seen is None or abs(fraction - seen) >= step or at - last >= wait


def shown(reports: DataFrame, least_step: float = STEP, least_seconds: float = WAIT) -> DataFrame:
    """Of (label, seq, at_s, fraction) the reports that are shown: each moves on, or comes late enough, from the last shown.

    Whether a report is shown depends on the last one that was, so each label (one encode) is walked in order;
    ``streaming.live.throttled`` does the same as reports come.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, last, seen = None, None, None
        for b in batches:
            show = []
            for name, at, share in zip(*(b.column(c).to_pylist() for c in ("label", "at_s", "fraction"))):
                if name != label:
                    label, last = name, None
                share = None if share is None or share != share else share
                show.append(moves_on(share, at, seen, last, least_step, least_seconds))
                if show[-1]:
                    last, seen = at, share
            yield b.filter(pa.array(show, pa.bool_()))

    ordered = reports.select("label", "seq", "at_s", "fraction").repartition("label").sortWithinPartitions("label", "seq")
    return ordered.mapInArrow(walk, "label string, seq long, at_s double, fraction double")


def chunks(queue: DataFrame, order: str, size: int = 2000, most: int = 50_000) -> DataFrame:
    """The first ``most`` files of a queue in order, with the chunk that each is sent in."""
    top = queue.orderBy(order).limit(most)  # the feature's limit: the shown queue is cut there
    return top.withColumn("nth", F.row_number().over(Window.orderBy(order))).withColumn("chunk", F.floor((F.col("nth") - 1) / size).cast("int"))

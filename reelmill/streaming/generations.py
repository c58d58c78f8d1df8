"""Scans of which only the newest goes on: an older one's jobs are cancelled by their tag, and its results are not published."""

from __future__ import annotations

import threading
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class Generations:
    """Runs scans of a session, each with a number; starting one supersedes those before it."""

    def __init__(self, spark: SparkSession, name: str = "scan"):
        self.spark, self.name, self.newest, self.lock = spark, name, 0, threading.Lock()
        self.published: dict[int, object] = {}
        self.running: dict[int, threading.Thread] = {}

    def tag(self, generation: int) -> str:
        return f"{self.name}-{generation}"

    def start(self, scan: Callable[[Callable[[], bool]], DataFrame], publish: Callable[[DataFrame], object]) -> int:
        """Begin a scan and cancel the older ones; its number.

        ``scan`` gets a test that tells whether it is out of date, for loops in the driver. ``publish`` runs the jobs; what
        it returns counts only if no newer scan has begun by then.
        """
        with self.lock:
            self.newest += 1
            mine = self.newest
        for older in [g for g in self.running if g < mine]:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(older))

        def work() -> None:
            self.spark.sparkContext.addJobTag(self.tag(mine))
            try:
                result = publish(scan(lambda: self.newest > mine))
            except (Py4JError, PySparkException):
                if self.newest == mine:  # not because it was cancelled
                    raise
                return
            finally:
                self.spark.sparkContext.removeJobTag(self.tag(mine))
            with self.lock:
                if self.newest == mine:
                    self.published[mine] = result

        self.running[mine] = InheritableThread(target=work, daemon=True)
        self.running[mine].start()
        return mine

    def wait(self, seconds: float | None = None) -> None:
        for t in list(self.running.values()):
            t.join(seconds)

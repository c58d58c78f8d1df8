"""A library folder as a batch source: one row a video file, with the reason where a rule leaves it out."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from reelmill.functions.names import extension
from reelmill.operators.rules import ignore_reason
from reelmill.settings import Settings

#: Folder names that are never entered.
PRUNED = (".Trashes", ".Spotlight-V100", ".fseventsd", ".TemporaryItems", "originals", "new versions", "archived")
DDL = "path string, name string, size long, mtime long"
#: Folders to walk from which levels are no longer split, levels looked at by the driver, and tasks at most.
ENOUGH, LEVELS, TASKS = 256, 4, 4096


class FolderReader(DataSourceReader):
    """Walks folders in parallel; links are not followed and pruned folders not entered.

    The upper levels are split until there are enough folders to walk, so one large folder is many tasks.
    """

    def __init__(self, root: str, left_out: frozenset[str]):
        self.root, self.left_out = root, left_out

    def enters(self, folder: str) -> bool:
        return os.path.basename(folder) not in PRUNED and os.path.realpath(folder) not in self.left_out and not os.path.islink(folder)

    def inner(self, folder: str) -> list[str]:
        try:
            with os.scandir(folder) as found:
                return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and self.enters(e.path))
        except OSError:
            return []

    def partitions(self):
        upper, walked = [], [self.root]
        for _ in range(LEVELS):
            if len(walked) >= ENOUGH:
                break
            upper, walked = upper + walked, [f for folder in walked for f in self.inner(folder)]
        folders = [(f, False) for f in upper] + [(f, True) for f in walked]
        return [InputPartition(folders[i::TASKS]) for i in range(min(TASKS, len(folders)))]

    def read(self, partition) -> Iterator[tuple]:
        for top, deep in partition.value:
            yield from self.walk(top, deep)

    def walk(self, top: str, deep: bool) -> Iterator[tuple]:
        for folder, inner, names in os.walk(top):
            inner[:] = sorted(d for d in inner if deep and self.enters(os.path.join(folder, d)))
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                    yield path, name, stat.st_size, int(stat.st_mtime)
                except OSError:
                    yield path, name, None, None


class LibrarySource(DataSource):
    """Format ``reelmill-library``; options path and leftout (folders, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "reelmill-library"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> FolderReader:
        left_out = frozenset(os.path.realpath(x) for x in self.options.get("leftout", "").split("\n") if x)
        return FolderReader(self.options["path"], left_out)


def scan(spark: SparkSession, s: Settings) -> DataFrame:
    """Video files below the source folder with ``ext`` and ``ignore_reason`` (null for files to work on)."""
    spark.dataSource.register(LibrarySource)
    left_out = "\n".join(x for x in (s.output_dir, s.archive) if x)
    rows = spark.read.format("reelmill-library").option("path", s.src).option("leftout", left_out).load()
    rows = rows.where(~F.startswith("name", F.lit("._"))).withColumn("ext", extension(F.col("name"))).where(F.col("ext").isin(*s.video_exts))
    return rows.withColumn("ignore_reason", ignore_reason(F.col("name"), F.col("size"), s))


def work(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("ignore_reason").isNull())

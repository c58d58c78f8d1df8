"""Resume ledger, probe cache and picks: joins of a library with what is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill.settings import Settings

KEY = ["signature", "path", "size", "mtime"]
LEDGER_DDL = "signature string, path string, size long, mtime long"


def keyed(media: DataFrame, s: Settings, picked: Column | None = None) -> DataFrame:
    """``media`` with its ledger signature: that of the settings, marked for files picked for software encoding."""
    signature = F.lit(s.signature())
    if picked is not None:
        signature = F.when(picked, F.concat(signature, F.lit("|sw"))).otherwise(signature)
    known = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("size", "mtime") if c in media.columns}  # a file that is gone counts as 0
    return media.withColumns({"signature": signature} | known)


def ledger_line(signature: Column, path: Column, size: Column, mtime: Column) -> Column:
    """A line of the ledger file; a file that is gone counts as size and time 0."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").cast("string")
    return F.concat_ws("\t", signature, path, number(size), number(mtime))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LEDGER_DDL, quote="", escape="")


def ledger_lines(spark: SparkSession, path: str) -> int:
    """Lines of a ledger, of whatever settings; blank ones don't count."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def clear_ledger(spark: SparkSession, path: str) -> int:
    """Empty a ledger and return how many lines it had."""
    had = ledger_lines(spark, path)
    spark.createDataFrame([], LEDGER_DDL).write.mode("overwrite").csv(path, sep="\t")
    return had


def by_name(results: DataFrame, queue: DataFrame) -> DataFrame:
    """Results whose file name is in the queue: by name, not by path, so files of one name stand for each other."""
    return results.join(queue.select("name").distinct(), "name", "left_semi")


def append_ledger(done: DataFrame, path: str) -> None:
    done.select(*KEY).write.mode("append").csv(path, sep="\t", quote="", escape="")


def resumed(media: DataFrame, ledger: DataFrame, s: Settings) -> DataFrame:
    """Files that the ledger holds under these settings. Spark broadcasts the ledger where its size allows."""
    return (media if s.ledger_enabled else media.limit(0)).join(ledger.select(*KEY), KEY, "left_semi")


def pending(media: DataFrame, ledger: DataFrame, s: Settings) -> DataFrame:
    return media.join(ledger.select(*KEY), KEY, "left_anti") if s.ledger_enabled else media


def recorded(results: DataFrame) -> DataFrame:
    """Results that go to the ledger: all but resumed files, failed probes and errors."""
    return results.where(~F.col("outcome").isin("resume", "error") & ~((F.col("outcome") == "skip-codec") & ~F.col("probed")))


def filled(scan: DataFrame, probed: DataFrame, value: str, default: Column, order: str | None = None) -> DataFrame:
    """``scan`` with the cached value of each file, or the default; as many rows as it has, whatever the cache holds.

    The cache is a log to which probes are appended. Of several probes of a file the newest counts (by ``order``, else
    by value); where both tables have size and mtime, a probe of another size or time is out of date and isn't taken.
    """
    key = [c for c in ("path", "size", "mtime") if c in scan.columns and c in probed.columns]
    newest = probed.groupBy(*key).agg(F.max_by(value, F.struct(*([order] if order else []), value)).alias("cached_value"))
    side = newest.withColumnsRenamed({c: f"cached_{c}" for c in key})
    same = [scan[c].eqNullSafe(side[f"cached_{c}"]) for c in key]
    return scan.join(side, same, "left").withColumn(value, F.coalesce("cached_value", default)).select(*[c for c in scan.columns if c != value], value)


def stored_ledger(ledger: DataFrame, table: str, path: str, buckets: int = 32) -> DataFrame:
    """The ledger as a table by signature, its lines bucketed by file; under each signature a line once.

    A run reads its own signature's folder only, and the join with the library doesn't shuffle it: choose ``buckets``
    so that one of a signature fits a task.
    """
    once = ledger.select(*KEY).dropDuplicates(KEY).repartition(buckets, *KEY[1:])
    once.write.mode("overwrite").partitionBy("signature").bucketBy(buckets, *KEY[1:]).sortBy(*KEY[1:]).option("path", path).format("parquet").saveAsTable(table)
    return ledger.sparkSession.table(table)


def held_files(media: DataFrame, ledger: DataFrame, signature: str, how: str = "left_semi") -> DataFrame:
    """The files (path, size, mtime) that a stored ledger holds under one signature, or with ``left_anti`` those it doesn't."""
    return media.join(ledger.where(F.col("signature") == signature).select(*KEY[1:]), KEY[1:], how)


def with_picks(media: DataFrame, picks: DataFrame) -> DataFrame:
    """``media`` with ``picked``: whether its path is in ``picks``."""
    marks = picks.select(F.col("path").alias("pick_path")).distinct().withColumn("hit", F.lit(True))
    return media.join(marks, media.path == F.col("pick_path"), "left").withColumn("picked", F.coalesce("hit", F.lit(False))).drop("hit", "pick_path")


def latest(first: DataFrame, retry: DataFrame, key: list[str]) -> DataFrame:
    """Results of a run with those of a retry in their place: the last attempt of each key."""
    both = first.withColumn("attempt", F.lit(0)).unionByName(retry.withColumn("attempt", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc("attempt"))
    return both.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def newest_generation(rows: DataFrame, generation: str) -> DataFrame:
    """Only rows of the newest scan; earlier ones are stale."""
    return rows.join(rows.agg(F.max(generation).alias("newest")), F.col(generation) == F.col("newest"), "left_semi")

"""Helpers shared by the corpus operators: shared-folder tables and word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contract: x20 and x09 to x0D. ``bytes.split()`` cuts at exactly these.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where all tasks run in this process (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="reelmill-checkpoint-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables that this process has written, in order.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``written`` for a result that comes in parts of one schema (at least one): each is a folder of one table."""
    spark = path = schema = None
    for i, df in enumerate(parts):
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/reelmill/{name}-{uuid.uuid4().hex}"
            _TABLES.append(path)
        df.write.parquet(f"{path}/part_of_table={i}")
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def forget(spark: SparkSession, since: int, *keep: str) -> None:
    """Remove the tables written after the first ``since`` of this process, but for those of the names to keep."""
    conf, stay = spark._jsc.hadoopConfiguration(), []
    for path in _TABLES[since:]:
        if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep:
            stay.append(path)
        else:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    _TABLES[since:] = stay
    release(spark)


def tables_so_far() -> int:
    return len(_TABLES)


#: Bits of a sieve at most: 32 MB. It takes 16 to 32 bits a key up to some 10 million keys, and lets more rows through beyond.
SIEVE_BITS = 1 << 28


def sieve(keys: DataFrame, key: str, most: int = SIEVE_BITS) -> Callable[[str], Column]:
    """A test of a column by its name: false only for values that are not among ``keys`` (a written table).

    A Bloom filter of two hashes, gathered as words of 64 bits and broadcast. Where wide rows are wanted whose key is
    in a table, or not in it, those that the sieve tells apart need no shuffle; the others (about one in a hundred
    more than wanted) are joined. The same way is taken at every size.
    """
    bits = min(most, 1 << max(16, (16 * keys.count()).bit_length()))
    places = lambda c: [F.pmod(F.xxhash64(F.lit(i), c), F.lit(bits)) for i in range(2)]
    place = keys.select(F.explode(F.array(*places(key))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may(one: pd.Series, two: pd.Series) -> pd.Series:
        hit = [(sent.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) for p in (one.to_numpy(), two.to_numpy())]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return lambda c: may(*places(c))


def heavy_keys(counts: DataFrame, key: str, n: str, least: int = 10_000) -> list:
    """Keys with over a thousandth of all rows (and over ``least``), of a table of keys with their numbers of rows.

    No table has more than 1,000 such keys, so the list has a bound whatever the data.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col(n) > max(least, total // 1000))).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, heavy: list) -> DataFrame:
    """``left`` joined with ``right`` (one row a key), rows of ``heavy`` keys without a shuffle.

    The at most 1,000 rows of ``right`` with heavy keys are broadcast; all other keys have at most a thousandth
    of the rows each and are joined as usual.
    """
    if not heavy:
        return left.join(right, key, how)
    dense = F.coalesce(F.col(key).isin([F.lit(k) for k in heavy]), F.lit(False))
    few = left.where(dense).join(F.broadcast(right.where(dense)), key, how)
    return left.where(~dense).join(right, key, how).unionByName(few)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark longs with the same bits."""
    return np.ascontiguousarray(x).view(np.int64)


LONG = 2**63 - 1


def cut_score(n: int) -> tuple[int, bytes | None]:
    """A whole number as a long, cut to the ends of its range, and where it is at or beyond them bytes that sort as the numbers do.

    Sorted by both, numbers of any size are in their order; ``whole_score`` gives the number back.
    """
    if -LONG - 1 < n < LONG:
        return n, None
    size = (abs(n).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return (LONG, b"\x01" + data) if n > 0 else (-LONG - 1, b"\x00" + bytes(255 - x for x in data))


def whole_score(score: int, wide: bytes | None) -> int:
    if wide is None:
        return score
    return int.from_bytes(wide[5:], "big") if wide[0] else -int.from_bytes(bytes(255 - x for x in wide[5:]), "big")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()],
        schema=schema,
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

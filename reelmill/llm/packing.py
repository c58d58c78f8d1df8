"""Operator 4: conflict-constrained best-fit packing of documents into sequences of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import batch, heavy_keys, spread_join, written

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("pack", pa.int64()), ("bin", pa.int32()), ("offset", pa.int64()),
])
DDL = "doc_id long, piece int, start long, length long, pack long, bin int, offset long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each item of (length, source, cluster), taken as they come, lengths from 0 to capacity.

    Bins are kept in order of residual; the search starts at the least residual that holds the item and goes
    from successor to successor until a bin has neither the item's source nor its duplicate cluster. Sources
    and clusters are numbered as they appear, so that a bin's bitmap is one integer. No compatible bin: a new one.
    """
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            residual, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        placed.append((b, capacity - residual))
        insort(order, (residual - length, b))
    return placed


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster", rows: int = 4096) -> DataFrame:
    """Pack every document of ``docs`` into bins of ``capacity`` units, whole where it fits.

    A document longer than a bin is cut: its full pieces are bins by themselves, the rest is packed. Rests
    are dealt at random, by a hash of the id, to packs of about ``rows`` rows, and each pack is filled by
    best fit on decreasing length. No bin holds two documents of one source or of one duplicate cluster, so a
    hot source or a large group of copies is spread over bins, and over packs by the hash. Rows that repeat one
    id and cluster over ``rows`` times are numbered and dealt by their number, so a pack's memory is bounded by
    ``rows``, not by the table.

    Returns doc_id, piece, start and length in units of the document, pack, bin (numbered within the pack)
    and offset. Documents of null or negative length count as 0 and still get a
    place; null ids, sources and clusters are ordinary values (one null source conflicts with another);
    equal lengths go by id; repeated rows are packed one by one; an empty table gives no rows.
    """
    columns = [id_col, length_col, source_col, cluster_col]
    names = ["doc_id", "length", "source", "cluster"]
    df = docs.select(
        F.col(id_col).cast("long").alias(names[0]), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias(names[1]),
        *[F.xxhash64(F.col(c).cast("string")).alias(n) for c, n in zip(columns[2:], names[2:])],
    )
    total = df.count()
    packs = max(1, -(-total // rows))
    df = df.withColumn("k", F.xxhash64("doc_id", "cluster"))
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    often = written(counts.where(F.col("n") > rows).select("k", F.lit(True).alias("often")), "often")
    if often.isEmpty():
        df = df.withColumn("pack", F.pmod("k", F.lit(packs)))
    else:
        numbered = written(df.withColumn("number", F.monotonically_increasing_id()), "numbered")
        df = spread_join(numbered, often, "k", "left", heavy_keys(counts, "k", "n"))
        df = df.withColumn("pack", F.pmod(F.when(F.col("often"), F.xxhash64("k", "number")).otherwise(F.col("k")), F.lit(packs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][0] != row[0]:
                    yield filled(held)
                    held = []
                held.append(row)
        if held:
            yield filled(held)

    def filled(group: list[tuple]) -> pa.RecordBatch:
        full, rest = [], []
        for p, doc_id, length, source, cluster in group:
            pieces = length // capacity
            full += [(doc_id, i, i * capacity, capacity) for i in range(pieces)]
            if length % capacity or not length:
                rest.append((length - pieces * capacity, doc_id, pieces, source, cluster))
        rest.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
        at = best_fit([(r[0], r[3], r[4]) for r in rest], capacity)
        first = max((b for b, _ in at), default=-1) + 1
        out = [(r[1], r[2], r[2] * capacity, r[0], group[0][0], b, o) for r, (b, o) in zip(rest, at)]
        out += [(d, i, s, n, group[0][0], first + k, 0) for k, (d, i, s, n) in enumerate(full)]
        return batch(SCHEMA, **{n: list(c) for n, c in zip(SCHEMA.names, zip(*out))})

    return df.select("pack", *names).repartition("pack").sortWithinPartitions("pack").mapInArrow(run, DDL)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 8192 code points; equal texts are one duplicate cluster."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs)


def packed(docs: DataFrame, capacity: int = 8192) -> DataFrame:
    """``pack`` for a table of documents: code points as units, equal texts as clusters.

    Null and empty texts have length 0 and still get a place, very long ones are cut into full bins and a rest,
    null ids and sources are values like others, repeated rows are packed one by one, an empty table gives no
    rows; other columns are not read.
    """
    return pack(docs.select("doc_id", F.length("text").alias("length"), "source", F.xxhash64("text").alias("cluster")), capacity)

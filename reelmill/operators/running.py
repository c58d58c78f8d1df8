"""Running sums, numbers and last values over orders of any length, by ranges and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.tables import kept

PART, TIE = "range_part", "range_tie"


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` as a table with ``range_part``: ranges of (by, order) that follow one another, equal keys dealt by a hash of the row.

    The range of a row is written with it, so whatever reads the table later sees the same ranges. A shuffle that
    is planned twice would sample its bounds twice, and adaptive execution could join other partitions each time.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(TIE, F.xxhash64(*rows.columns)).repartitionByRange(n, *by, *order, TIE)
    return kept(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def with_running(rows: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None, last: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with running sums up to each row, their totals (``name_all``), and the values of the row before (null for the first).

    Sums run within ``by`` in ``order``. A run may be all rows: it is cut into ranges, each summed by itself; one row a
    range and run, summed over the ranges before, gives the offsets. No window but that of these few rows spans a
    run, so a task holds a range. Rows equal in ``order`` follow one another in any one order. Nulls in ``order`` come
    first; null summands count as nothing.
    """
    by, last = by or [], last or {}
    table = ranged(rows, by, order, parts).withColumns({f"sum_of_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"last_of_{n}": c for n, c in last.items()})
    place = F.struct(*order, TIE)
    own = table.groupBy(*by, PART).agg(
        *[F.sum(f"sum_of_{n}").alias(f"own_{n}") for n in sums], *[F.max_by(F.struct(F.col(f"last_of_{n}").alias("v")), place).alias(f"end_{n}") for n in last]
    )
    whole, before = Window.partitionBy(*by or [F.lit(0)]), Window.partitionBy(*by or [F.lit(0)]).orderBy(PART)
    offsets = own.withColumns(
        {f"before_{n}": F.sum(f"own_{n}").over(before) - F.col(f"own_{n}") for n in sums} | {f"{n}_all": F.sum(f"own_{n}").over(whole) for n in sums} | {f"from_{n}": F.lag(f"end_{n}").over(before) for n in last}
    ).drop(*[f"own_{n}" for n in sums], *[f"end_{n}" for n in last])
    inside = Window.partitionBy(*by, PART).orderBy(*order, TIE)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = table.withColumns({n: F.sum(f"sum_of_{n}").over(upto) for n in sums} | {n: F.lag(F.struct(F.col(f"last_of_{n}").alias("v"))).over(inside) for n in last})
    keys = [*by, PART]
    named = offsets.withColumnsRenamed({k: f"offset_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"offset_{k}")) for k in keys]
    both = placed.join(named, same)
    both = both.withColumns({n: F.col(n) + F.col(f"before_{n}") for n in sums} | {n: F.coalesce(F.col(n), F.col(f"from_{n}"))["v"] for n in last})
    return both.select(*rows.columns, *sums, *[f"{n}_all" for n in sums], *last)

"""Operator 2: proportional stratified interleaving of a corpus into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed number of ranges into which a uniform rank is cut; each range is ranked by itself.
RANGES = 1024


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")


def crc_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def interleave(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards whose mixture of strata matches the corpus.

    Rows of a stratum are shuffled by an MD5 of seed and id and ranked; row r of n gets the fractional
    rank (r - u) / n, where u from 0 to 1 is a hash of the stratum's name (many strata of one row spread out). All rows are then ordered by fractional rank and cut into equal runs, so shard
    row counts differ by one at most and each stratum is spread evenly (law ``rows``).

    No stratum is ranked in one task: the shuffle key cuts it into ``4096`` hash ranges, counts of
    (stratum, range) give each range its offset, and the same is done with ranges of the fractional rank.
    Only ids, sizes and checksums are shuffled, never texts.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and stratum.
    Null ids and null strata are ordinary values (a null stratum is a stratum of its own), null texts count
    as empty, repeated rows are kept apart in any order, an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size_of(F.col(text_col)).alias("size"),
        crc_of(F.col(text_col)).alias("text_crc32"),
        F.col(stratum_col).cast("string").alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("key"),
    ).withColumn("cut", F.substring("key", 1, 3))
    key = ["key", "doc_id", "text_crc32", "size"]
    # each stratum starts elsewhere in its step, else all strata of one row would share one rank
    phase = F.conv(F.substring(F.md5(F.coalesce("stratum", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)

    counts = rows.groupBy("stratum", "cut").agg(F.count("*").alias("n"))
    by_cut = Window.partitionBy("stratum").orderBy("cut")
    offsets = counts.select(
        F.col("stratum").alias("o_stratum"),
        F.col("cut").alias("o_cut"),
        (F.sum("n").over(by_cut) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("of"),
    )
    ranked = (
        rows.withColumn("at", F.row_number().over(Window.partitionBy("stratum", "cut").orderBy(*key)))
        .join(offsets, F.col("stratum").eqNullSafe(F.col("o_stratum")) & (F.col("cut") == F.col("o_cut")))
        .withColumn("rank", (F.col("before") + F.col("at") - phase) / F.col("of"))
        .withColumn("range", F.floor(F.col("rank") * RANGES).cast("int"))
    )

    totals = ranked.groupBy("range").agg(F.count("*").alias("n"))  # at most RANGES rows
    upto = Window.partitionBy(F.lit(0)).orderBy("range")
    starts = totals.select(
        F.col("range").alias("s_range"),
        (F.sum("n").over(upto) - F.col("n")).alias("start"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    order = Window.partitionBy("range").orderBy("rank", "stratum", *key)
    position = F.col("start") + F.col("nth") - 1
    return (
        ranked.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(starts), F.col("range") == F.col("s_range"))
        .select("doc_id", "size", "text_crc32", "stratum", "total", position.alias("position"))
        .withColumn("shard", F.expr(f"cast((position * {shards}) div total as int)"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            # the first position of shard s is ceil(s * total / shards)
            (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "stratum",
        )
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40, seed=17)


OP2_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT doc_id, source AS stratum, hex(encode(coalesce(text, ''))) AS body, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    md5('17:' || coalesce(doc_id::varchar, 'null')) AS key
  FROM documents
), rows AS (
  SELECT doc_id, stratum, size, key,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(size - 16), lambda i: ('0x' || body[2 * i + 1 : 2 * i + 2])::bigint)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM docs, crc_table
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - ('0x' || md5(coalesce(stratum, ''))[1:8])::bigint / 4294967296.0::double) / count(*) OVER (PARTITION BY stratum) AS rank
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY rank, stratum NULLS FIRST, key, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'rows' AS law, ((position * 40) // total)::int AS shard,
  (position - (((position * 40) // total) * total + 39) // 40)::bigint AS slot, NULL::int AS grown_shard, stratum
FROM placed
"""

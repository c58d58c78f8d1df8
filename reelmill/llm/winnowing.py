"""Operator 8: document fingerprints by winnowing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import fresh

#: Fixed values of the rolling hash: a prime below 2^31, so that products fit a long, and a base.
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: A window minimum is one long: 31 bits of gram hash above 32 bits that fall as the position rises.
PLACE = 32
#: Bytes of text that one range of ids holds, and ranges at most.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 16
#: A token is a word, or one character of a script that is written without spaces (Thai to Hangul).
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF}"
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row; inside a lambda it would be for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)  # one parameter: a second one would be the index


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(1 + by), F.greatest(F.size(a) - by, F.lit(0)))


def rolled(x: Column, k: int) -> Column:
    """The rolling (Karp-Rabin) hash of each run of ``k`` values: sum of x[i + j] * BASE^(k - 1 - j) modulo PRIME.

    Hashes of a and b values make those of a + b, so all runs are rolled up in some log2(k) passes over the
    array. Runs that pass the end are padded with zeros.
    """
    def joined(left: Column, right: Column, reach: int, more: int) -> Column:
        power = F.lit(pow(BASE, more, PRIME)).cast("long")
        return F.zip_with(left, shifted(right, reach), lambda a, b: (a * power + F.coalesce(b, F.lit(0).cast("long"))) % F.lit(PRIME))

    def roll(v: Column) -> Column:
        a, reach = v, 1
        for bit in bin(k)[3:]:
            a = bound(a, lambda w, reach=reach: joined(w, w, reach, reach))
            reach *= 2
            if bit == "1":
                a = joined(a, v, reach, 1)
                reach += 1
        return a

    return bound(x, roll)


def least_of(a: Column, reach: int) -> Column:
    """The least of each run of ``reach`` values, in some log2(reach) passes; the last pass overlaps, runs at the end are shorter."""
    span = 1
    while span < reach:
        step = min(span, reach - span)
        a = bound(a, lambda v, step=step: F.zip_with(v, shifted(v, step), lambda x, y: F.least(x, y)))
        span += step
    return a


def whole_runs(a: Column, reach: int) -> Column:
    """Without the shorter runs at the end, but at least one value where there is any."""
    return bound(a, lambda v: F.slice(v, 1, F.greatest(F.size(v) - reach + 1, F.least(F.size(v), F.lit(1)))))


def marks(text: Column, k: int, window: int) -> Column:
    """The distinct window minima of a text as longs of hash and place, in order of position."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    low = (1 << PLACE) - 1
    keyed = F.transform(whole_runs(rolled(tokens, k), k), lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(F.lit(low) - i.cast("long")))
    return F.array_distinct(whole_runs(least_of(keyed, window), window))


def hashes_of(found: Column) -> Column:
    return F.transform(found, lambda v: F.shiftright(v, PLACE))


def winnow(df: DataFrame, text_col: str = "text", out_col: str = "marks", k: int = 4, window: int = 8) -> DataFrame:
    """``df`` with ``out_col``: array of structs (hash long of 31 bits, position int), in order of position.

    The text is cut into tokens; each run of ``k`` tokens has a rolling hash, and of each ``window`` hashes the
    least is kept, the rightmost on ties, with its position. Any run of ``k + window - 1`` equal tokens that
    two texts share gives at least one equal hash in both. Hashes and minima are built by doubling, so a text
    costs a few passes whatever its length; positions go up to 2^31. A text of fewer than ``k`` tokens is one
    gram, padded with zeros; a null text or one without tokens has none. Ties keep the rightmost; repeated rows
    get equal fingerprints; an empty table gives none; an existing column of that name stays and the new one
    gets an underscore.
    """
    out_col = fresh(df, out_col)
    low = (1 << PLACE) - 1
    mark = lambda v: F.struct(F.shiftright(v, PLACE).alias("hash"), (F.lit(low) - v.bitwiseAND(F.lit(low))).cast("int").alias("position"))
    return df.withColumn(out_col, F.transform(marks(F.col(text_col), k, window), mark))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def place_in(bounds: list[int], value: str, per: int = 256) -> tuple[Column, list | None]:
    """How many of the sorted ``bounds`` are at most ``value``; for many bounds in two steps, the second over a table (chunk, fine)."""
    count = lambda array: F.size(F.filter(array, lambda b: b <= F.col(value)))
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if len(bounds) <= per:
        return (count(literal(bounds)) if bounds else F.lit(0)), None
    chunks = [bounds[i : i + per] for i in range(0, len(bounds), per)]
    return count(literal([c[0] for c in chunks])), list(enumerate(chunks, 1))


def in_ranges(docs: DataFrame, order: str, tie: str, ranges: int) -> DataFrame:
    """``docs`` with ``at`` (its range of ``order``) and ``own``; each range also holds the row that follows its last.

    Descending order, nulls last; after the last row comes the first. The bounds are ``ranges`` quantiles, rows of
    a null order go by 256 ranges of ``tie``, and the first row of each range, found by an aggregate of one row a
    range, is copied to the range before it.
    """
    fractions = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx(order, fractions, 10 * ranges)).first()[0] or []))
    place, table = place_in(bounds, order)
    if table is None:
        placed = docs.withColumn("at", place)
    else:
        fine = F.broadcast(docs.sparkSession.createDataFrame(table, "chunk int, fine array<long>"))  # at most 256 rows
        found = docs.withColumn("chunk_of", place).join(fine, F.col("chunk_of") == F.col("chunk"), "left")
        inner = F.size(F.filter("fine", lambda b: b <= F.col(order)))
        placed = found.withColumn("at", F.when(F.col("chunk_of") == 0, 0).otherwise((F.col("chunk_of") - 1) * 256 + inner)).drop("chunk_of", "chunk", "fine")
    placed = placed.withColumn("at", F.when(F.col(order).isNull(), F.shiftright(tie, 56).cast("int") - 128).otherwise(F.col("at")))
    heads = placed.groupBy("at").agg(F.max(F.struct(order, tie)).alias("head"))  # one row a range
    by = Window.partitionBy(F.lit(0)).orderBy("at")
    heads = heads.select(
        F.col("at").alias("h_at"), "head",
        F.coalesce(F.lead("at").over(by), F.min("at").over(Window.partitionBy(F.lit(0)))).alias("before"),
    )
    copies = F.when(F.struct(order, tie) == F.col("head"), F.array(F.struct(F.col("at").alias("at"), F.lit(True).alias("own")), F.struct(F.col("before").alias("at"), F.lit(False).alias("own"))))
    return (
        placed.join(F.broadcast(heads), F.col("at") == F.col("h_at"))
        .withColumn("copy", F.explode(F.coalesce(copies, F.array(F.struct(F.col("at").alias("at"), F.lit(True).alias("own"))))))
        .drop("at", "h_at", "head", "before")
        .select("*", "copy.at", "copy.own")
        .drop("copy")
        .repartitionById(ranges, "at")  # by its number: a hash would put several ranges into one task
    )


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to it and to the next document.

    Null texts are empty, documents of a null id come after all others, and rows that repeat one id follow each
    other by a hash of their text. Texts are shuffled once, into ranges of about 32 MB however large the table is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("at").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("tie"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.lead("text").over(order), F.lit(1), half))
    pairs = in_ranges(docs, "doc_id", "tie", ranges).withColumn("edited", F.coalesce(edited, F.lit("")))
    found = pairs.select(
        "doc_id", "at", "own", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        marks(F.col("text"), 4, 8).alias("mine"), marks(F.col("edited"), 4, 8).alias("theirs"),
    )
    found = found.withColumn("after", F.lead("mine").over(order)).where("own")
    digest = lambda c: F.md5(F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))))
    sets = found.withColumns({c: hashes_of(F.col(c)) for c in ("after",)} | {"mine_set": hashes_of(F.col("mine")), "theirs_set": hashes_of(F.col("theirs"))})
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("mine")).alias("fingerprint"), digest(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("mine_set"), F.col("theirs_set")).alias("near_edited"), likeness(F.col("mine_set"), F.col("after")).alias("near_next"),
        F.size("mine").alias("n_marks"),
    )

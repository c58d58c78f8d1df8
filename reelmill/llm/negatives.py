"""Operator 13: hard-negative mining by blocked dense products of broadcast anchors with all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.balltree import EXACT, integer_vectors, rows_of
from reelmill.llm.common import LONG, batch, cut_score, release, whole_score, written, written_parts

#: Anchors and components of anchors of one pass at most: what is broadcast, and what a task keeps for it, have a bound.
PASS_ROWS, PASS_SIZE = 8192, 1 << 21
#: Anchors and candidates of one matrix product.
BLOCKS = 1024, 4096
FOUND = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("score", pa.int64()), ("wide", pa.binary()), ("vec_id", pa.int64()), ("row", pa.int64())])
FOUND_DDL = "anchor long, nth int, score long, wide binary, vec_id long, row long"


def plain_rows(x: np.ndarray) -> np.ndarray:
    """Rows whose products with one another are exact in doubles in any order of summing."""
    return (np.abs(x).max(axis=1, initial=0.0) < np.sqrt(EXACT / max(1, x.shape[1]))) if len(x) else np.zeros(0, bool)


class Best:
    """The k first entries of each slot: by score from the highest, then id (null last), then row. Two may be merged by offering one's entries to the other."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, -np.inf)
        self.held = [np.zeros(0, t) for t in (np.int64, np.float64, bool, np.int64, np.int64)]
        self.whole: dict[int, list[tuple[int, bool, int, int]]] = {}  # entries whose scores are Python integers

    def offer(self, slot: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        good = score >= self.least[slot]
        if not good.any():
            return
        slot, score, none, ids, rows = (np.concatenate((h, c[good])) for h, c in zip(self.held, (slot, score, none, ids, rows)))
        order = np.lexsort((rows, ids, none, -score, slot))
        s = slot[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.held = [c[order] for c in (slot, score, none, ids, rows)]
        last = nth == self.k - 1
        self.least[self.held[0][last]] = self.held[1][last]

    def offer_whole(self, slot: int, score: int, none: bool, i: int, row: int) -> None:
        held = self.whole.setdefault(slot, [])
        held.append((-score, none, i, row))
        if len(held) > 4 * self.k:
            held[:] = sorted(held)[: self.k]

    def entries(self) -> Iterator[tuple[int, int, bool, int, int]]:
        yield from zip(self.held[0].tolist(), map(int, self.held[1].tolist()), *(c.tolist() for c in self.held[2:]))
        for slot, held in self.whole.items():
            yield from ((slot, -score, none, i, row) for score, none, i, row in sorted(held)[: self.k])


class Anchors:
    """The anchors of one pass, by the length of their vectors, with the score windows of their slots (one slot each: no windows)."""

    def __init__(self, table: pa.Table, windows: dict[int, list[tuple[int, int]]] | None, slots: int):
        self.slots, self.n, self.row = slots, table.num_rows, table["row"].to_numpy()
        self.labels = pc.unique(table["label"].combine_chunks())
        code = pc.index_in(table["label"], value_set=self.labels).to_numpy()
        self.low = self.high = None
        if windows is not None:
            self.low = [[w[0] for w in windows.get(r, [])] for r in self.row.tolist()]
            self.high = [[w[1] for w in windows.get(r, [])] for r in self.row.tolist()]
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        vectors = [rows_of(b, 0) for b in table.select(["v"]).to_batches()]
        vectors = [v for part in vectors for v in part]
        dims = np.array([len(v) for v in vectors], int)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            q = np.array([vectors[i] for i in at.tolist()], float).reshape(len(at), d)
            self.by_dim[d] = at, q, code[at], plain_rows(q)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows as doubles, (anchors, slots); an empty one where there is none. Plain scores lie within 2^53."""
        fill = lambda rows, empty: np.array([[*(max(-EXACT, min(EXACT, x)) for x in r), *[empty] * (self.slots - len(r))] for r in rows], float).reshape(self.n, self.slots)
        return fill(self.low, np.inf), fill(self.high, -np.inf)


def mined(rows: DataFrame, anchors: Anchors, same: bool, k: int, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """The ``k`` first of each anchor's slots among each task's rows (row, vec_id, label, v): of its label or, with windows, of others.

    Every task multiplies its rows with all anchors of the pass, block by block, and keeps the best: what it
    returns doesn't grow with its rows, and the best of all tasks are those of the table.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        low, high = own.bounds() if own.low is not None else (None, None)
        best = Best(own.n * own.slots, k)
        for b in batches:
            number = b.column(0).to_numpy()
            ids, none = b.column(1).fill_null(LONG).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)
            labels = pc.fill_null(pc.index_in(b.column(2), value_set=own.labels), -1).to_numpy()
            vectors = rows_of(b, 3)
            dims = np.array([len(v) for v in vectors], int)
            for d, (at, q, code, plain) in own.by_dim.items():
                mine = np.flatnonzero(dims == d)
                for s in range(0, len(mine), blocks[1]):
                    here = mine[s : s + blocks[1]]
                    x = np.array([vectors[i] for i in here.tolist()], float).reshape(len(here), d)
                    small = plain_rows(x)
                    for a in range(0, len(at), blocks[0]):
                        block = slice(a, a + blocks[0])
                        fits = (code[block, None] == labels[here]) == same
                        fits &= at_other_rows(own.row[at[block]], number[here])
                        easy = fits & plain[block, None] & small
                        with np.errstate(over="ignore", invalid="ignore"):
                            score = q[block] @ x.T
                        multiply(best, own, at[block], here, easy, score, none, ids, number, low, high)
                        if not (plain[block].all() and small.all()):
                            exactly(best, own, at[block], here, fits & ~easy, q[block], x, none, ids, number)
        out = []
        for slot, score, none, i, row in best.entries():
            out.append((int(own.row[slot // own.slots]), slot % own.slots, *cut_score(score), None if none else i, row))
            if len(out) == 20000:
                yield batch(FOUND, **{n: list(c) for n, c in zip(FOUND.names, zip(*out))})
                out = []
        if out:
            yield batch(FOUND, **{n: list(c) for n, c in zip(FOUND.names, zip(*out))})

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, FOUND_DDL)


def at_other_rows(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """False where the candidate is the anchor's own row."""
    out = np.ones((len(anchors), len(rows)), bool)
    own = np.isin(rows, anchors)
    if own.any():
        out[:, own] = anchors[:, None] != rows[own]
    return out


def multiply(best: Best, own: Anchors, at: np.ndarray, here: np.ndarray, fits: np.ndarray, score: np.ndarray, none, ids, number, low, high) -> None:
    """Offer the scores of one product: only those that can still matter to some slot are looked at one by one."""
    slots = at[:, None] * own.slots + np.arange(own.slots)
    if low is None:
        a, c = np.nonzero(fits & (score >= best.least[slots[:, 0]][:, None]))
        best.offer(slots[a, 0], score[a, c], none[here[c]], ids[here[c]], number[here[c]])
        return
    floor = np.maximum(low[at], best.least[slots])
    a, c = np.nonzero(fits & (score >= floor.min(axis=1)[:, None]) & (score <= high[at].max(axis=1)[:, None]))
    found = score[a, c]
    for p in range(own.slots):
        inside = (found >= floor[a, p]) & (found <= high[at[a], p])
        if inside.any():
            x, y = a[inside], here[c[inside]]
            best.offer(slots[x, p], found[inside], none[y], ids[y], number[y])


def exactly(best: Best, own: Anchors, at: np.ndarray, here: np.ndarray, fits: np.ndarray, q: np.ndarray, x: np.ndarray, none, ids, number) -> None:
    """Offer the pairs whose products may pass 2^53: in Python's integers."""
    pairs = [i.tolist() for i in np.nonzero(fits)]
    left, right = ({i: [int(v) for v in m[i].tolist()] for i in set(side)} for m, side in zip((q, x), pairs))
    for a, c in zip(*pairs):
        score = sum(u * v for u, v in zip(left[a], right[c]))
        entry = bool(none[here[c]]), int(ids[here[c]]), int(number[here[c]])
        if own.low is None:
            best.offer_whole(int(at[a]), score, *entry)
            continue
        for p, (low, high) in enumerate(zip(own.low[at[a]], own.high[at[a]])):
            if low <= score <= high:
                best.offer_whole(int(at[a]) * own.slots + p, score, *entry)


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each (anchor, nth) of what all tasks found, with their rank."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.desc("wide"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, pass_rows: int = PASS_ROWS, pass_size: int = PASS_SIZE, blocks: tuple[int, int] = BLOCKS,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of its label the ``negatives`` best rows of other labels in a window.

    A row's score is its inner product with the anchor, in whole numbers: components are floor(scale * x). Higher
    scores come first, then lesser ids. A negative's score is between ``low`` and ``high`` percent of the positive's.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors (rows where ``is_anchor`` holds on vec_id) go in passes of at most ``pass_rows`` anchors and ``pass_size``
    components, dealt by hash and counted before the first pass. A pass is broadcast; every task multiplies its
    blocks of rows with the blocks of anchors in doubles, which are exact below 2^53, and returns its own best
    for each anchor. The best of all tasks are the positives; a second pass over the rows takes the best of other
    labels within each positive's window. Pairs whose product may pass 2^53 are summed as Python integers (slowly);
    scores beyond a long are ranked as they are and returned cut to its ends.

    Rows with a null label, a null vector, or null or non-finite components (also after scaling) take no part.
    Vectors of another length than the anchor's are not compared with it. An anchor isn't its own positive, but other
    rows that repeat its id or vector are ordinary rows. Null ids come last on ties and are no anchors unless
    ``is_anchor`` says so; rows equal in score and id are taken in any one order. Anchors with no positive or no
    negative give no rows, as does an empty table. Labels of any type are compared as text. Other columns are not read.
    """
    label = F.col(label_col).cast("string").alias("label")
    own = integer_vectors(vectors.where(F.col(label_col).isNotNull()), id_col, vector_col, scale, label)
    own = own.withColumn("anchor", F.coalesce(is_anchor, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    rows = written(own.select("row", "vec_id", "label", "v", "dim", "anchor"), "vectors")
    anchors = rows.where("anchor")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("size"), F.coalesce(F.max("dim"), F.lit(0)).alias("widest")).first()
    passes = dealt(anchors, max(1, -(-size.n // pass_rows), -(-size["size"] // max(pass_size, size.widest))), pass_rows, max(pass_size, size.widest))

    def part(n: int) -> pa.Table:  # bounded by pass_rows and pass_size
        return anchors.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == n).select("row", "label", "v").toArrow()

    close = written_parts((firsts(mined(rows, Anchors(part(n), None, 1), True, positives, blocks), positives).withColumn("pass", F.lit(n)) for n in range(passes)), "positives")
    release(rows.sparkSession)

    def windowed(n: int) -> DataFrame:
        windows: dict[int, list] = {}
        for r in close.where(F.col("pass") == n).select("anchor", "score", "wide").orderBy("anchor", "rank").collect():  # at most ``positives`` an anchor
            score = whole_score(r.score, r.wide)
            windows.setdefault(r.anchor, []).append((-(-low * score // 100), high * score // 100))
        return firsts(mined(rows, Anchors(part(n), windows, positives), False, negatives, blocks), negatives)

    far = written_parts((windowed(n) for n in range(passes)), "negatives")
    release(rows.sparkSession)
    first = close.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    both = far.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(first, ["anchor", "nth"]).join(names, "anchor")
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def dealt(anchors: DataFrame, passes: int, rows: int, size: int) -> int:
    """Passes, at least so many, that none has more than ``rows`` anchors and ``size`` components."""
    while True:
        per = anchors.groupBy(F.pmod(F.xxhash64("row"), F.lit(passes))).agg(F.count("*").alias("n"), F.sum("dim").alias("size"))
        if per.where((F.col("n") > rows) | (F.col("size") > size)).isEmpty():
            return passes
        passes = passes + 1 + passes // 4


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose vec_id is divisible by 100; every seventh label is moved on by one first."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::bigint AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.rid <> c.rid AND len(a.v) = len(c.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS nth FROM s WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other))::int AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""

"""Operator 9: exact top-k inner-product search by ball trees, one per shard, with branch and bound."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import LONG, batch, cut_score, release, written

LEAF = 256
#: Cells at most: their balls go to every task, so their number has a bound. A cell has as many shards as its rows need.
MOST_CELLS = 4096
#: Below this all sums of products are exact in doubles; beyond it scores are summed as Python integers.
EXACT = 2.0**53
ROWS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("wide", pa.binary()), ("about", pa.float64()), ("times", pa.int64())])
ROWS_DDL = "query long, query_id long, vec_id long, row long, score long, wide binary, about double, times long"
#: Stands for a null id in a tree: after all others on ties.
NO_ID = LONG


class BallTree:
    """Vectors cut in halves along the line between two far points; each node keeps its centre and radius."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.copies, self.rows = ids[order], vectors[order], copies[order], rows[order]
        self.nodes: list[list] = []  # centre, radius, least id, members or [left, right]
        self.root = self.build(np.arange(len(ids)), leaf)
        self.largest = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        self.lengths = np.array([length(c) for c in self.centres])

    def build(self, members: np.ndarray, leaf: int) -> int:
        stack = [(members, -1, 0)]
        root = -1
        while stack:
            m, parent, side = stack.pop()
            x = self.x[m]
            unit = max(1.0, float(np.abs(x).max()) if x.size else 1.0)  # squares of large components stay finite
            x = x / unit
            centre = x.mean(axis=0)
            away = ((x - centre) ** 2).sum(axis=1)
            radius = float(np.sqrt(away.max()))
            at = len(self.nodes)
            self.nodes.append([centre * unit, radius * unit * (1 + 1e-9), int(self.ids[m].min()), m])
            if parent >= 0:
                self.nodes[parent][3][side] = at
            else:
                root = at
            if len(m) > leaf and radius > 0:
                a = x[away.argmax()]
                b = x[((x - a) ** 2).sum(axis=1).argmax()]
                cut = np.argpartition(x @ (b - a), len(m) // 2)
                self.nodes[at][3] = [-1, -1]
                stack += [(m[cut[: len(m) // 2]], at, 0), (m[cut[len(m) // 2 :]], at, 1)]
        return root

    def search(self, own: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int, int, int]]:
        """(score, id, copies, row) of the k best rows, none below ``floor``; of the query's own row (``own``) its other copies.

        Nodes wait in a heap by their upper bound q.c + |q| r; the search ends when the best waiting node is
        below the kth score. Scores are integers, so the bound is rounded up against float error, and a node
        that can only tie is entered only for the ids it might hold that are less than the kth's. A bound beyond
        doubles is infinite: that node is opened.
        """
        bounds = upper_bounds(self.centres, self.radii, self.lengths, q).tolist()
        whole = len(q) * self.largest * float(np.abs(q).max(initial=0.0)) >= EXACT
        exact_q = [int(v) for v in q.tolist()] if whole else None
        best: list[tuple[int, int, int, int]] = []  # (score, -id, copies, row): the worst first
        waiting = [(-bounds[self.root], self.root)]
        while waiting:
            bound, at = heapq.heappop(waiting)
            if -bound < floor or (len(best) == k and -bound < best[0][0]):
                break
            node = self.nodes[at]
            if len(best) == k and -bound < best[0][0] + 1 and node[2] > -best[0][1]:
                continue
            if isinstance(node[3], list):
                for child in node[3]:
                    heapq.heappush(waiting, (-bounds[child], child))
                continue
            m = node[3]
            m = m[(self.rows[m] != own) | (self.copies[m] > 1)]
            if whole:
                scores = np.array([sum(a * int(b) for a, b in zip(exact_q, row)) for row in self.x[m].tolist()], object)
            else:
                scores = self.x[m] @ q
            good = np.arange(len(m))
            if not whole:
                least = max(floor, best[0][0]) if len(best) == k else floor
                good = np.flatnonzero(scores >= least)
                if len(good) > k:  # only the k best of a leaf matter; ties keep the least id
                    good = good[np.lexsort((self.ids[m[good]], -scores[good]))[:k]]
            for i in good.tolist():
                row = int(self.rows[m[i]])
                entry = (int(scores[i]), -int(self.ids[m[i]]), int(self.copies[m[i]]) - (row == own), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i, n, row) for s, i, n, row in best]

    def packed(self) -> bytes:
        """The tree as bytes, for a table."""
        shape = [[n[2], *(n[3] if isinstance(n[3], list) else (-1, -1))] for n in self.nodes]
        members = [np.zeros(0, np.int64) if isinstance(n[3], list) else n[3] for n in self.nodes]
        out = io.BytesIO()
        np.savez(
            out, ids=self.ids, x=self.x, copies=self.copies, rows=self.rows, centres=self.centres, radii=self.radii, lengths=self.lengths,
            shape=np.array(shape, np.int64), members=np.concatenate(members), ends=np.cumsum([len(m) for m in members]),
        )
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        tree, has = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.ids, tree.x, tree.copies, tree.rows, tree.centres, tree.radii, tree.lengths = (has[n] for n in ("ids", "x", "copies", "rows", "centres", "radii", "lengths"))
        members, ends = has["members"], has["ends"].tolist()
        tree.nodes = [[None, None, least, [left, right] if left >= 0 else members[s:e]] for (least, left, right), s, e in zip(has["shape"].tolist(), [0, *ends], ends)]
        tree.root, tree.largest = 0, float(np.abs(tree.x).max()) if tree.x.size else 0.0
        return tree


def length(v: np.ndarray) -> float:
    """Euclidean length; large components don't overflow."""
    unit = float(np.abs(v).max(initial=0.0))
    return unit * float(np.linalg.norm(v / unit)) if unit > 0 else 0.0


def upper_bounds(centres: np.ndarray, radii: np.ndarray, lengths: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What no inner product of ``q`` with a vector of each ball passes; infinite where doubles can't tell."""
    size = length(q)
    with np.errstate(over="ignore", invalid="ignore"):
        found = centres @ q + size * radii
        found += 1e-9 * size * (lengths + radii) + 1e-6
    return np.where(np.isnan(found), np.inf, found)


def not_above(score: int) -> float:
    """The largest double that isn't above a whole number."""
    try:
        about = float(score)
    except OverflowError:
        return float(np.finfo(float).max) if score > 0 else -np.inf
    return about if about <= score else float(np.nextafter(about, -np.inf))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more: Column) -> DataFrame:
    """(vec_id, v array<double>, dim, *more): floor(scale * x) of every component; vectors with null or non-finite ones are left out.

    A double from 2^53 on is a whole number itself, so only smaller ones are floored.
    """
    scaled = lambda x: x.cast("double") * scale
    v = F.transform(F.col(vector_col), lambda x: F.when(F.abs(scaled(x)) >= EXACT, scaled(x)).otherwise(F.floor(scaled(x)).cast("double")))
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vector_col).alias("dim"), *more)


def rows_of(b: pa.RecordBatch, at: int) -> list[np.ndarray]:
    column = b.column(at)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def pivots_of(rows: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of components the numbers and vectors of rows drawn by hash, around which cells lie."""
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(cells).select("v", "dim").collect()  # at most MOST_CELLS
    by_dim: dict[int, tuple[list[int], list]] = {}
    for i, r in enumerate(drawn):
        at, vs = by_dim.setdefault(r.dim, ([], []))
        at.append(i)
        vs.append(r.v)
    return {d: (np.array(at), np.array(vs, float).reshape(len(at), d)) for d, (at, vs) in by_dim.items()}


def with_cells(rows: DataFrame, pivots: dict) -> DataFrame:
    """``rows`` with ``cell``: the nearest pivot, so that a shard's ball is small; -1 where none has its length."""
    names, at = rows.columns, rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            vectors = rows_of(b, at)
            dims = np.array([len(v) for v in vectors])
            for d, (place, p) in pivots.items():
                mine = np.flatnonzero(dims == d)
                for s in range(0, len(mine), 1024):
                    x = np.array([vectors[i] for i in mine[s : s + 1024]], float).reshape(-1, d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        away = (p**2).sum(axis=1) - 2 * x @ p.T
                    cell[mine[s : s + 1024]] = place[np.nan_to_num(away, nan=np.inf).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*names, "cell"])

    return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)


def trees(rows: DataFrame, pivots: dict, shard_rows: int) -> DataFrame:
    """(dim, cell, part, centre, radius, reach, tree) for every shard of ``rows`` (row, vec_id, v, dim, times): its ball tree, built once.

    Shards are the cells around the pivots; a cell of over ``shard_rows`` rows is cut by a hash, so shards don't grow with
    the table. ``reach`` is the radius of the shard's rows about the cell's pivot.
    """
    placed = written(with_cells(rows, pivots), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))
    cut = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
    order = ["dim", "cell", "part"]
    dealt = cut.select(*order, F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "v", "times", "row").repartition(*order).sortWithinPartitions(*order)
    names = [*order, "centre", "radius", "reach", "tree"]
    types = pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.binary()
    middle = {int(c): v for _, (at, vs) in pivots.items() for c, v in zip(at, vs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, copies, numbers = None, [], [], [], []

        def built() -> pa.RecordBatch:
            tree = BallTree(np.array(ids, np.int64), np.array(vectors, float).reshape(len(ids), -1), np.array(copies, np.int64), np.array(numbers, np.int64))
            pivot = middle.get(key[1], np.zeros(key[0]))
            reach = max((length(v - pivot) for v in tree.x), default=0.0) * (1 + 1e-9)
            row = *key, tree.centres[tree.root].tolist(), float(tree.radii[tree.root]), reach, tree.packed()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for b in batches:
            for d, c, p, i, v, n, r in zip(*(b.column(x).to_pylist() for x in (0, 1, 2, 3)), rows_of(b, 4), *(b.column(x).to_pylist() for x in (5, 6))):
                if (d, c, p) != key:
                    if ids:
                        yield built()
                    key, ids, vectors, copies, numbers = (d, c, p), [], [], [], []
                ids.append(i)
                vectors.append(v)
                copies.append(n)
                numbers.append(r)
        if ids:
            yield built()

    return dealt.mapInArrow(run, "dim int, cell int, part int, centre array<double>, radius double, reach double, tree binary")


def balls_of(built: DataFrame, pivots: dict) -> list[tuple[int, int, np.ndarray, float]]:
    """(dim, cell, centre, radius) of every cell: its one shard's own ball, or of several the ball about the pivot."""
    per = built.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach"), F.first("centre").alias("centre"), F.first("radius").alias("radius"))
    middle = {int(c): v for _, (at, vs) in pivots.items() for c, v in zip(at, vs)}
    rows = per.collect()  # at most MOST_CELLS and one for each number of components without a pivot
    return [(r.dim, r.cell, np.array(r.centre, float), r.radius) if r.n == 1 else (r.dim, r.cell, middle.get(r.cell, np.zeros(r.dim)), r.reach) for r in rows]


def routed(queries: DataFrame, balls: list, low: int, high: int | None) -> DataFrame:
    """(query, query_id, v, times, floor, dim, cell): each query once for the cells in places ``low`` to ``high`` of its order by upper bound.

    The bound of a cell is q.c + |q| r; those below the query's floor are left out.
    """
    sent = queries.sparkSession.sparkContext.broadcast(balls)  # (dim, cell, centre, radius), at most MOST_CELLS
    names = ["query", "query_id", "v", "times", "floor", "dim", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, tuple] = {}
        for d in {b[0] for b in sent.value}:
            own = [b for b in sent.value if b[0] == d]
            centres = np.array([b[2] for b in own], float).reshape(len(own), -1)
            by_dim[d] = np.array([b[1] for b in own]), centres, np.array([b[3] for b in own]), np.array([length(c) for c in centres])
        for b in batches:
            floors = b.column(4).to_numpy(zero_copy_only=False)
            at, dim, cell = [], [], []
            for i, v in enumerate(rows_of(b, 2)):
                if len(v) not in by_dim:
                    continue
                cells, *ball = by_dim[len(v)]
                bounds = upper_bounds(*ball, v)
                order = np.argsort(-bounds, kind="stable")[low:high]
                order = order[bounds[order] >= floors[i]]
                at += [i] * len(order)
                dim += [len(v)] * len(order)
                cell += cells[order].tolist()
            out = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(dim, pa.int32()), pa.array(cell, pa.int32())], names=names)

    return queries.select(*names[:-2]).mapInArrow(run, "query long, query_id long, v array<double>, times long, floor double, dim int, cell int")


def met(built: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """Search each routed query in the trees of its cell's shards; a cell that very many queries ask is read by several tasks."""
    cuts = written(asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    data = built.join(cuts, ["dim", "cell"]).select("dim", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("asks"), "tree")
    shards = built.select("dim", "cell", "part")
    sides = asked.join(cuts, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).join(shards, ["dim", "cell"])
    none = lambda t: F.lit(None).cast(t)
    place = ["dim", "cell", "part", "block"]
    data = data.select(*place, "asks", "tree", none("long").alias("query"), none("long").alias("query_id"), none("array<double>").alias("v"), none("long").alias("times"), none("double").alias("floor"))
    sides = sides.select(*place, F.lit(1).alias("asks"), none("binary").alias("tree"), "query", "query_id", "v", "times", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            asks, data, query, own, vectors, _, floor = (b.column(i) for i in range(4, 11))
            out = []
            for i in range(b.num_rows):
                if not asks[i].as_py():
                    tree = BallTree.unpacked(data[i].as_py())
                    continue
                q = np.array(vectors[i].as_py(), float)
                found = tree.search(query[i].as_py(), q, k, floor[i].as_py())
                out += [(query[i].as_py(), own[i].as_py(), None if c == NO_ID else c, row, *cut_score(s), not_above(s), n) for s, c, n, row in found]
            if out:
                yield batch(ROWS, **{n: list(c) for n, c in zip(ROWS.names, zip(*out))})

    dealt = data.unionByName(sides).repartition(*place).sortWithinPartitions(*place, "asks")
    return dealt.mapInArrow(run, ROWS_DDL)


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 8192, block_rows: int = 2048, waves: tuple[int, ...] = (1, 4)) -> DataFrame:
    """The k highest inner products of each query row with every other row, ties to the lesser id.

    Rows are cut into shards around drawn rows and each shard's ball tree is built and written once. Queries
    (rows where ``is_query`` holds on vec_id) are routed in waves: first to the cell of the highest upper bound,
    then to the next ``waves``, then to all others that can still matter. After each wave every query's kth score so
    far is its floor: cells, shards and nodes below it are never opened. The best k of all partial results are exact.
    Every task holds one shard's tree of some ``shard_rows`` rows, however large the table; nothing is gathered but the
    cells' balls (4,096 at most: a cell of more rows has several shards in one ball).

    Vectors null or holding null or non-finite components (also after scaling) take no part. Components may
    be as large as doubles are: where sums of products pass 2^53 they are summed as whole numbers, ranked as they
    are, and cut to the ends of a long in the result. Vectors of another number of components are compared among themselves.
    Rows of a null id are candidates (after all others on ties) and never queries. A query is a row: rows that
    repeat an id get k places each, and every other row is a candidate, those of the query's id or vector too; rows
    equal in id and vector are searched once and counted by their number. Zero vectors and empty tables are ordinary
    cases; other columns are not read.
    """
    each = integer_vectors(vectors, id_col, vector_col, scale)
    rows = written(each.groupBy("vec_id", "v", "dim").agg(F.count("*").alias("times")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    pivots = pivots_of(rows, min(MOST_CELLS, max(1, round(rows.count() / shard_rows))))
    built = written(trees(rows, pivots, shard_rows), "trees")
    balls = balls_of(built, pivots)
    asked = rows.where(F.col("vec_id").isNotNull()).where(is_query)
    queries = written(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "times"), "queries")
    floors = queries.withColumn("floor", F.lit(float("-inf")))
    cuts = [0, *np.cumsum(waves).tolist(), None]
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("wide"), F.asc_nulls_last("vec_id"), "row")
    found = None
    for low, high in zip(cuts[:-1], cuts[1:]):
        if low and low >= len(balls):
            break
        part = met(built, routed(floors, balls, low, high), k, block_rows)
        together = part if found is None else found.unionByName(part)
        # copies of a candidate take a place each; no more than k of them matter
        found = written(together.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth"), "found")
        release(rows.sparkSession)
        kth = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("about")).alias("kth"))
        floors = queries.join(kth, "query", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    copy = lambda n: F.explode(F.sequence(F.lit(1), F.least(n, F.lit(k))))
    ranked = found.withColumn("copy", copy("times")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.join(queries.select("query", F.col("times").alias("asks")), "query")
    return ranked.withColumn("ask", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asks")))).select("query_id", "rank", "vec_id", "score")


def op9_balltree(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows for every embedding whose vec_id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST))::int AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

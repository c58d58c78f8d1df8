"""Operator 3: SimHash near-duplicate classes, candidates by chains of segments (pigeonring)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import forget, fresh, heavy_keys, mix, release, sieve, signed, spread_join, tables_so_far, written
from reelmill.llm.components import components

BITS = 64
#: Rows of a key beyond which it is cut into blocks; every pair of blocks is still compared.
BLOCK = 2048


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of A-Z lower-cased words; the whole sequence if it is shorter."""
    w = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), 42)] if w else [], np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``docs`` without its text, with fingerprint (the 64 bits as a long) and shingles (their number)."""
    keep = [c for c in docs.columns if c != text_col]
    fp, n = fresh(docs, "fingerprint"), fresh(docs, "shingles")
    out = docs.select(*keep).withColumns({fp: F.lit(0).cast("long"), n: F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, count = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()):
                h = shingle_hashes(text, words)
                found[i], count[i] = simhash(h), len(h)
            columns = [*b.columns[:-1], pa.array(signed(found)), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, fp, n])

    return docs.select(*keep, text_col).mapInArrow(run, out)


def with_set_prints(texts: DataFrame, words: int) -> DataFrame:
    """(id, row, fp, twin, digest, n) of each (id, row, body): the halves of a 128-bit fingerprint, a 128-bit digest and the size of the set of distinct shingles."""
    zero = F.lit(0).cast("long")
    out = texts.select("id", "row", zero.alias("fp"), zero.alias("twin"), F.lit(b"").alias("digest"), zero.alias("n")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, twin = (np.zeros(b.num_rows, np.uint64) for _ in range(2))
            n, digest = np.zeros(b.num_rows, np.int64), []
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                h = np.unique(shingle_hashes(text, words))
                fp[i], twin[i], n[i] = simhash(h), simhash(mix(h)), len(h)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            made = pa.array(signed(fp)), pa.array(signed(twin)), pa.array(digest, pa.binary()), pa.array(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["id", "row", "fp", "twin", "digest", "n"])

    return texts.select("id", "row", "body").mapInArrow(run, out)


def masks(bits: int, at_most: int) -> list[int]:
    """Every way to flip at most so many of the lowest bits."""
    return [sum(1 << i for i in c) for r in range(at_most + 1) for c in combinations(range(bits), r)]


def key_plan(distance: int, segments: int) -> tuple[int, list[int], list[int]]:
    """Segments that the join key spans, and the flips that each of its two sides makes.

    A chain that starts at segment i may differ by floor(l * distance / segments) bits over its first l
    segments. With a budget of 0 for one segment the key takes two: the first equal, the flips on the second.
    """
    width, one = BITS // segments, distance // segments
    if one:
        return 1, masks(width, one // 2), masks(width, one - one // 2)
    return 2, [0], masks(width, 2 * distance // segments)


def pair_blocks(starts: np.ndarray, ends: np.ndarray, small: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one group, in blocks, for groups that lie one after the other.

    Small groups together: each row with the next of its group, then the one after that, and so on. Others by themselves.
    """
    size = ends - starts
    last = np.repeat(ends, size)
    i = np.arange(starts[0], ends[-1])[np.repeat(size <= small, size)]
    step = 0
    while True:
        step += 1
        i = i[i + step < last[i - starts[0]]]
        if not len(i):
            break
        yield i, i + step
    for s, e in zip(starts[size > small].tolist(), ends[size > small].tolist()):
        rows = max(1, (1 << 20) // (e - s))
        for at in range(s, e, rows):
            i, j = np.meshgrid(np.arange(at, min(e, at + rows)), np.arange(at + 1, e), indexing="ij")
            yield i[i < j], j[i < j]


def near_pairs(starts: np.ndarray, ends: np.ndarray, fp: np.ndarray, n: np.ndarray, distance: int, similarity: float, few: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one group, in blocks of rising i, whose ``fp`` differ by ``distance`` or fewer bits.

    Groups lie one after the other, each in order of ``n``. A row is compared with the rows behind it up to the first whose
    n is too large for ``similarity`` (rounded up: the bound itself is left to the caller). Groups with ``few`` such
    rows in the mean are compared together, larger ones in blocks of 64 rows.
    """
    size, here = ends - starts, np.arange(ends[-1])
    last = np.repeat(ends, size)
    if similarity > 0:
        width = int(n.max()) + 2
        base = np.repeat(np.arange(len(size)) * width, size)
        last = np.searchsorted(base + n, base + np.minimum((n / similarity).astype(np.int64) + 1, width - 1), side="right")
    ahead = last - here - 1
    dense = np.add.reduceat(ahead, starts) > few * size
    rows = here[~np.repeat(dense, size) & (ahead > 0)]
    total, step = np.cumsum(ahead[rows]), 1 << 16
    for a in np.split(rows, np.searchsorted(total, np.arange(step, total[-1], step))) if len(rows) else ():
        count = ahead[a]
        until = np.cumsum(count)
        if not len(a):
            continue
        j = np.arange(until[-1]) + np.repeat(a + 1 - (until - count), count)
        at = np.flatnonzero(np.bitwise_count(np.repeat(fp[a], count) ^ fp[j]) <= distance)
        yield a[np.searchsorted(until, at, side="right")], j[at]
    for s, e in zip(starts[dense].tolist(), ends[dense].tolist()):
        for at in range(s, e, 64):
            to = min(e, at + 64)
            end = int(last[to - 1])
            if end > at + 1:
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(fp[at:to, None] ^ fp[None, at + 1 : end]) <= distance), end - at - 1)
                i, j = i + at, j + at + 1
                fits = (i < j) & (j < last[i])
                yield i[fits], j[fits]


def chained(key: np.ndarray, x: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Places of the differences ``x`` that pass the chain from their key's start segment, then the Hamming check.

    The budgets are in proportion to the length of the chain.
    """
    width, start, at = BITS // segments, (key >> 60) % segments, np.arange(len(x))
    total = np.zeros(len(x), np.uint8)
    for step in range(segments):
        shift = ((start[at] + step) % segments * width).astype(np.uint64)
        total = total + np.bitwise_count((x[at] >> shift) & np.uint64((1 << width) - 1))
        fits = total <= (step + 1) * distance // segments
        at, total = at[fits], total[fits]
    return at


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of links that join all that the links (a, b) join; nearest first, so the closest pairs stay."""
    ends, label = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = label[: len(a)], label[len(a) :]
    root, found = np.arange(len(ends)), []
    for level in np.unique(bits).tolist():
        at = np.flatnonzero(bits == level)
        while True:
            low, high = np.minimum(root[a[at]], root[b[at]]), np.maximum(root[a[at]], root[b[at]])
            at, low, high = (v[low != high] for v in (at, low, high))
            if not len(at):
                break
            pick = np.unique(high, return_index=True)[1]  # one link for each root that moves
            found.append(at[pick])
            to = np.arange(len(root))
            to[high[pick]] = low[pick]
            while (to[to] != to).any():
                to = to[to]
            root = to[root]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def candidates(key: np.ndarray, fp: np.ndarray, twin: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int, segments: int, similarity: float) -> np.ndarray:
    """Places of the pairs (i, j) of rows of one key that pass the chain, the Hamming check and the bounds on twin and n.

    ``twin`` is the other half of the fingerprint (zeros where there is none): sets far apart in it can't be
    similar, and a pair near in both halves is met in the first half's keys.
    """
    at = chained(key[i], fp[i] ^ fp[j], distance, segments)
    i, j = i[at], j[at]
    other = np.bitwise_count(twin[i] ^ twin[j])
    fits = (other <= 2 * distance) & (similarity * np.maximum(n[i], n[j]) <= np.minimum(n[i], n[j]))
    return at[fits & ((other > distance) | (key[i] >> 60 < segments))]


def with_keys(nodes: DataFrame, segments: int, spans: int) -> DataFrame:
    """``nodes`` (node, fp, twin, n, ...) once for each start segment of each half, with its key ``base``; fp is that half."""
    width = BITS // segments
    part = lambda f, i: F.shiftrightunsigned(f, i % segments * width).bitwiseAND((1 << width) - 1)
    body = lambda f, i: part(f, i) if spans == 1 else F.shiftleft(part(f, i), width).bitwiseOR(part(f, i + 1))
    halves = [("fp", "twin"), ("twin", "fp")] if "twin" in nodes.columns else [("fp", None)]
    keys = [
        F.struct(F.lit((h * segments + i) << 60).cast("long").bitwiseOR(body(F.col(f), i)).alias("base"), F.col(f).alias("fp"), (F.col(t) if t else F.lit(0).cast("long")).alias("twin"))
        for h, (f, t) in enumerate(halves) for i in range(segments)
    ]
    rest = [c for c in nodes.columns if c not in ("fp", "twin")]
    return nodes.select(*rest, F.explode(F.array(*keys)).alias("k")).select(*rest, "k.*")


def key_sizes(based: DataFrame, flips: list[int]) -> DataFrame:
    """(key, count, total): rows of each key that ``flipped`` gives and the sum of their n, from counts of the keys before the flips."""
    sizes = based.groupBy("base").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
    each = sizes.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
    return each.groupBy(F.col("base").bitwiseXOR(F.col("flip")).alias("key")).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def flipped(based: DataFrame, flips: list[int], *rest: str) -> DataFrame:
    each = based.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
    return each.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "node", "fp", "twin", "n", *rest)


def near_links(nodes: DataFrame, distance: int = 3, segments: int = 4, block: int = BLOCK, similarity: float = 0.0) -> DataFrame:
    """Links (a, b) that join every two nodes whose fingerprints differ by ``distance`` or fewer bits, directly or by others.

    ``nodes`` has node and fp, and where there are more: twin (a second half of the fingerprint; either half
    within ``distance`` is enough, if the other is within twice that) and n (the size of the set behind it;
    ``similarity`` bounds the ratio of two sizes).

    Pigeonring: if two fingerprints differ by at most ``distance`` bits, then from some segment on every
    chain of l consecutive segments of the ring differs by at most l * distance / segments. Each start
    segment gives keys over the chain's first segments (one side as it is, the other with the allowed flips);
    rows of a key meet in one group sorted by n, where rows of similar size are compared by the full Hamming distance
    and then by longer chains. Of a group only spanning links leave, so a dense class costs rows in proportion to
    its size. A key with more than ``block`` rows on the first side is cut into blocks and every pair of blocks is a group.
    """
    spans, still, flips = key_plan(distance, segments)
    nodes = nodes.where("node is not null and fp is not null").distinct()
    based = with_keys(nodes if "n" in nodes.columns else nodes.withColumn("n", F.lit(1).cast("long")), segments, spans)
    exact = flipped(based, still).withColumn("side", F.lit(0))
    others = [x for x in flips if x not in still]
    rows = exact.unionByName(flipped(based, others).withColumn("side", F.lit(1))) if others else exact
    hot = written(key_sizes(based, still).where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    columns = ["key", "x", "y", "side", "node", "fp", "twin", "n"]
    if hot.isEmpty():
        rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:  # the first side's block meets every block of either side
        cut = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        firsts = cut.where("side = 0").withColumns({"x": F.col("own"), "y": F.col("other")})
        partners = cut.withColumns({"x": F.col("other"), "y": F.col("own"), "side": F.lit(1)})  # first-side rows are also partners
        rows = firsts.select(*columns).unionByName(partners.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _, side, node, fp, twin, n), starts, ends in whole_groups(batches, 3):
            f, t, found, held = fp.view(np.uint64), twin.view(np.uint64), [], 0

            def joined(found: list) -> tuple[np.ndarray, np.ndarray]:
                i, j = (np.concatenate(c) for c in zip(*found))
                at = spanning(node[i], node[j], np.bitwise_count(f[i] ^ f[j]))
                return i[at], j[at]

            for i, j in near_pairs(starts, ends, f, n, distance, similarity):
                at = ((side[i] == 0) | (side[j] == 0)) & (node[i] != node[j])
                i, j = i[at], j[at]
                at = candidates(key, f, t, n, i, j, distance, segments, similarity)
                if len(at):
                    found.append((i[at], j[at]))
                    held += len(at)
                if held > 1 << 20:  # spanning links of those so far and of the next are spanning links of all
                    found = [joined(found)]
                    held = len(found[0][0])
            if found:
                i, j = joined(found)
                a, b = node[i], node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.select(*columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "n").mapInArrow(run, "a long, b long")


def _and_end(batches):
    yield from batches
    yield None


def near_classes(fingerprints: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``fingerprints`` (column fp): root is the least that links (a, b) reach."""
    fp = fingerprints.select("fp").where("fp is not null").distinct()
    linked = components(links)
    return fp.join(linked, fp.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each row of (node, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signed(np.unique(shingle_hashes(t.as_py(), words))) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "body").mapInArrow(run, "node long, shingles array<bigint>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have this Jaccard similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("a_set", "b_set")) >= F.lit(similarity) * F.size(F.array_union("a_set", "b_set"))).select("a", "b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Columns of several groups of rows with equal first ``keys`` columns, and where each group begins and ends.

    Groups of one row are left out; lists stay Arrow arrays.
    """
    join = lambda h, c: pa.concat_arrays([h, c]) if isinstance(c, pa.Array) else np.concatenate((h, c))
    held: list | None = None
    for b in _and_end(batches):
        if b is not None:
            now = [c if pa.types.is_nested(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = now if held is None else [join(h, c) for h, c in zip(held, now)]
        if held is None or not len(held[0]) or (b is not None and len(held[0]) < rows):
            continue
        n, cut = len(held[0]), np.zeros(len(held[0]) - 1, bool)
        for c in held[:keys]:
            cut |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.flatnonzero(cut) + 1))
        ends = np.append(starts[1:], n)
        if b is not None:  # the last group may go on
            starts, ends, rest = starts[:-1], ends[:-1], int(starts[-1])
        else:
            rest = n
        several = ends - starts > 1
        if several.any():
            size = (ends - starts)[several]
            mine = np.repeat(several, ends - starts)
            chunk = [c.slice(0, rest).filter(pa.array(mine)) if isinstance(c, pa.Array) else c[:rest][mine] for c in held]
            yield chunk, np.cumsum(size) - size, np.cumsum(size)
        held = [c[rest:] for c in held]


def met_here(a: np.ndarray, b: np.ndarray, key: np.ndarray, flips: int, segments: int) -> np.ndarray:
    """Whether ``key`` is the first that a and b share: of the first segment they share keys of, the least of two."""
    width, start = BITS // segments, (key >> 60) % segments
    low_bits = np.uint64((1 << width) - 1)
    first = np.ones(len(a), bool)
    for s in range(segments):
        first &= (s >= start) | (np.bitwise_count((a ^ b) >> np.uint64(s * width) & low_bits) > 2 * flips)
    shift = (start * width).astype(np.uint64)
    a, b = (a >> shift) & low_bits, (b >> shift) & low_bits
    rest, low = a ^ b, np.zeros_like(a)
    for _ in range(flips):  # half way between them
        bit = rest & (~rest + np.uint64(1))
        rest, low = rest ^ bit, low | bit
    return first & (np.minimum(a ^ low, b ^ low) == (key.view(np.uint64) & low_bits))


def open_links(nodes: DataFrame, sets: DataFrame, similarity: float, distance: int, segments: int = 4, block: int = 4096, shingles: int = 1 << 22) -> DataFrame:
    """Links (a, b) that join, with the roots, every two candidates of ``near_links`` of this similarity.

    ``nodes`` has node, fp, twin, n (shingles in its set) and root (what links checked before have joined). A
    pair is open if its roots differ; every open pair is looked at in the first key it shares. Groups of
    fingerprints name the members of open pairs, only these bring their sets to the group again, and there a
    pair is passed over only if its sets are too different or links that have passed the check join it. Keys
    with more than ``block`` rows or ``shingles`` shingles are cut into blocks; every two blocks are a group.
    """
    flips = (distance // segments + 1) // 2
    based, ways = with_keys(nodes, segments, 1), masks(BITS // segments, flips)
    rows = flipped(based, ways, "root")
    blocks = F.ceil(F.greatest(F.col("count") / block, F.col("total") / shingles)).cast("int")
    hot = written(key_sizes(based, ways).select("key", blocks.alias("blocks")).where("blocks > 1"), "hot")
    rows = rows.withColumns({"x": F.lit(0), "y": F.lit(0), "own": F.lit(0)})
    if not hot.isEmpty():
        cut = rows.drop("own").join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = cut.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    columns = ["key", "x", "y", "own", "node", "fp", "twin", "root", "n"]

    def met(i: np.ndarray, j: np.ndarray, key, x, y, own, fp, twin, root, n) -> np.ndarray:
        """Places of the open pairs, of near rows i and j, that their key is the first to hold."""
        at = np.flatnonzero((root[i] != root[j]) & ((x[i] == y[i]) | (own[i] != own[j])))
        i, j = i[at], j[at]
        other = np.bitwise_count(twin[i] ^ twin[j])
        fits = (other <= 2 * distance) & ((other > distance) | (key[i] >> 60 < segments)) & (similarity * np.maximum(n[i], n[j]) <= np.minimum(n[i], n[j]))
        at, i, j = at[fits], i[fits], j[fits]
        return at[met_here(fp[i], fp[j], key[i], flips, segments)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y, own, node, fp, twin, root, n), starts, ends in whole_groups(batches, 3):
            f, t, member = fp.view(np.uint64), twin.view(np.uint64), np.zeros(len(fp), bool)
            for i, j in near_pairs(starts, ends, f, n, distance, similarity):
                at = met(i, j, key, x, y, own, f, t, root, n)
                member[i[at]] = member[j[at]] = True
            if member.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[member]) for c in (key, x, y, own, node, fp, twin, root, n)], names=columns)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y, own, node, fp, twin, root, n, held), starts, ends in whole_groups(batches, 3, 2):
            f, t = np.ascontiguousarray(fp).view(np.uint64), np.ascontiguousarray(twin).view(np.uint64)
            offsets = held.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            ids, label = (np.unique(c, return_inverse=True)[1] for c in (held.flatten().to_numpy(), root))
            mark, out = np.zeros(len(ids), bool), []
            for a, b in near_pairs(starts, ends, f, n, distance, similarity):
                at = met(a, b, key, x, y, own, f, t, root, n)
                each, begins = np.unique(a[at], return_index=True)
                for i, c in zip(each.tolist(), np.split(b[at], begins[1:])):
                    c = c[label[c] != label[i]]
                    if not len(c):
                        continue
                    mark[ids[offsets[i] : offsets[i + 1]]] = True
                    shared = mark[np.concatenate([ids[offsets[j] : offsets[j + 1]] for j in c.tolist()])].astype(np.int64)
                    shared = np.add.reduceat(shared, np.cumsum(n[c]) - n[c])
                    mark[ids[offsets[i] : offsets[i + 1]]] = False
                    for j in c[shared >= similarity * (n[i] + n[c] - shared)].tolist():
                        if label[i] != label[j]:
                            out.append((node[i], node[j]))
                            label[label == label[j]] = label[i]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = lambda df, *more: df.select(*columns, *more).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "n")
    found = written(dealt(rows).mapInArrow(find, "key long, x int, y int, own int, node long, fp long, twin long, root long, n long"), "open")
    return dealt(found.join(sets, "node"), "shingles").mapInArrow(check, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, distance: int = 11) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the least id.

    Each set of distinct ``words``-word shingles has a 128-bit SimHash. Sets with either half at ``distance`` or
    fewer bits are candidates, and a link stays if the two sets have this Jaccard similarity. Spanning links of the
    candidates are checked first; then all other candidates that they leave apart, so no pair is left out for
    links that fail. Two sets at 0.8 are 9.7 bits of 64 apart in the mean: by the binomial law 11 bits in either of
    two halves find 93 % of the pairs at 0.8, 98 % at 0.85 and all but a thousandth at 0.9 (directly; others of
    a class may link them too). Texts of equal shingle sets (by a 128-bit hash of the set) are copies;
    others of equal fingerprint are candidates. Texts without words (null, empty, white space) are copies; a null
    id sorts first; of rows equal in id and text one stays; an empty table stays empty; other columns are kept
    whatever their names.

    Of the texts only those of candidates are shuffled for their sets, and those to drop for the result: a sieve of
    their rows (``common.sieve``) lets all others pass where they are, at every size.
    """
    name, since, spark = fresh(docs, "row_x"), tables_so_far(), docs.sparkSession
    row = F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.xxhash64(text_col).cast("string"))
    source = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("body"))
    own = written(with_set_prints(source, words), "fingerprints")
    sets_of = own.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.min("fp").alias("fp"), F.min("twin").alias("twin"), F.max("n").alias("n"))
    firsts = written(sets_of.drop("digest").withColumn("node", F.monotonically_increasing_id()), "firsts")
    some = firsts.where("n > 0")
    links = written(near_links(some.select("node", "fp", "twin", "n"), distance, block=4 * BLOCK, similarity=similarity).distinct(), "links")
    release(spark)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    asked = written(some.join(ends, "node").select("node", "fp", "twin", "n", F.col("first.row").alias("row")), "asked")
    wanted = sieve(asked, "row")
    bodies = source.where(wanted("row")).join(asked.select("row", "node"), "row").dropDuplicates(["row"])
    sets = written(shingle_sets(bodies, words), "shingles")
    release(spark)
    firm = written(components(alike(links, sets, similarity)), "firm")
    nodes = written(asked.drop("row").join(firm, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    release(spark)
    more = written(open_links(nodes, sets, similarity, distance), "more")
    release(spark)
    if not more.isEmpty():
        firm = components(firm.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = firsts.join(firm, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    stay = written(roots.groupBy("root").agg(F.min("first").alias("first")).select("first.row"), "stay")
    times = own.groupBy("row").agg(F.count("*").alias("times"))
    gone = written(own.select("row").distinct().join(stay, "row", "left_anti").withColumnRenamed("row", name), "gone")
    several = written(times.where("times > 1").join(stay, "row", "left_semi").select(F.col("row").alias(name)), "several")
    forget(spark, since, "gone", "several")
    touched = sieve(gone.unionByName(several), name)
    named = docs.withColumn(name, row)
    rest = named.where(touched(name)).join(gone, name, "left_anti")
    if not several.isEmpty():  # rows equal in id and text
        rest = rest.join(several, name, "left_anti").unionByName(rest.join(several, name, "left_semi").dropDuplicates([name]))
    return named.where(~touched(name)).unionByName(rest).select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its 3-word SimHash and the least doc_id that links of 3 bits or fewer reach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = written(with_fingerprints(docs, "text", 3).select("doc_id", F.col("fingerprint").alias("fp")), "fingerprints")
    classes = near_classes(own, near_links(own.select(F.col("fp").alias("node"), "fp"), 3))
    prints = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).join(classes, "fp"), "prints")
    roots = written(prints.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "roots")
    named = spread_join(prints.select("fp", "root"), roots.select("root", "component_id"), "root", "inner", heavy_keys(roots, "root", "size")).select("fp", "component_id")
    return spread_join(own, named, "fp", "inner", heavy_keys(prints, "fp", "times")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Operator 12: n-gram Jaccard join by parity sketches, joined by pigeonhole within bands of set sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import forget, heavy_keys, mix, release, sieve, signed, spread_join, tables_so_far, written
from reelmill.llm.components import components
from reelmill.llm.simhash import pair_blocks, shingle_hashes, shingle_sets, spanning, whole_groups

#: Rows of a key beyond which it is cut into blocks; every two blocks are still compared.
BLOCK = 4096
#: Ways to deal tokens into segments that a set may use, one after the other, until enough of its segments hold tokens.
SEEDS = 3
SALT = np.uint64(0x9E3779B97F4A7C15)


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of sets of sizes a and b with a Jaccard similarity of ``percent`` of a hundred."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(band, segments, differences) of each band in which a set of ``n`` tokens looks for partners.

    Band j belongs to pairs whose larger set has 2**(j-1) to 2**j - 1 tokens. Its sketches have more segments than
    any such pair has differences, half as many again. ``differences`` is the bound for this set's own partners.
    """
    largest = 100 * n // percent
    for j in range(n.bit_length(), largest.bit_length() + 1):
        differences = most_apart(n, min(2**j - 1, largest), percent)
        if differences:  # else only equal sets
            d = most_apart(2**j - 1, 2**j - 1, percent)
            yield j, d + 2 + d // 2, differences


def segment_keys(tokens: np.ndarray, band: int, segments: int, seed: int, empty: bool = False) -> np.ndarray:
    """The keys of the segments that hold tokens, those with the most tokens first; with ``empty`` also of the others.

    A segment's key is the XOR of its tokens' hashes: the parities of a sketch so wide that no two tokens share a bit.
    """
    own = mix(tokens ^ mix(SALT + np.arange(seed, seed + 1, dtype=np.uint64)))
    place = ((own >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    at, first, count = np.unique(place[order], return_index=True, return_counts=True)
    parity = np.bitwise_xor.reduceat(mix(own + SALT)[order], first)
    if empty:
        rest = np.setdiff1d(np.arange(segments, dtype=np.uint64), at)
        at, parity, count = (np.concatenate(c) for c in ((at, rest), (parity, np.zeros(len(rest), np.uint64)), (count, np.zeros(len(rest), int))))
    key = mix(parity + mix(at + np.uint64((band << 8 | seed) << 32)))
    return key[np.lexsort((key, -count))]


def join_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which every two similar but different sets share one.

    Two sets that differ in d tokens differ in at most d of a band's segments. Of the keys of ``have`` segments with
    tokens they share at least have - d, so in any one order of keys the first d + 1 of each side hold a common one.
    Where a set has too few segments with tokens for that, a pair may agree in empty segments only; but then both
    are such sets, and meet in another dealing of the tokens or in the end in the keys of empty segments.
    """
    found = []
    for band, segments, differences in bands(len(tokens), percent):
        for seed in range(SEEDS):
            keys = segment_keys(tokens, band, segments, seed)
            if len(keys) <= differences and seed == SEEDS - 1:
                keys = segment_keys(tokens, band, segments, seed, empty=True)
                found.append(keys)
                break
            found.append(keys[: differences + 1])
            if len(keys) > differences:
                break
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The set's parities of 4 to 10 bits a token, in words of 64 bits. Half of it XOR the other half is the sketch of half the bits."""
    bits = 64 << max(0, (100 * len(tokens) // percent).bit_length() - 5)
    parity = np.bincount((mix(tokens + SALT) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each) with fewer words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text, so that the text can be had from the source again."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.xxhash64(text_col).cast("string"))


def with_keys(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, row, node, n, keys) of each (id, row, body): a 128-bit digest of the set of shingles, its size and its join keys."""
    schema = "id long, row string, node binary, n long, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, keys = [], [], []
            for text in b.column(2):
                tokens = np.unique(shingle_hashes(text.cast(pa.binary()).as_py(), words))
                node.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                n.append(len(tokens))
                keys.append(signed(join_keys(tokens, percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "row", "node", "n", "keys"])

    return docs.select("id", "row", "body").mapInArrow(run, schema)


def postings(sets: DataFrame) -> DataFrame:
    """(key, nid, n) of the keys that two or more sets have.

    Most keys are of one set, so all are shuffled once, packed. Very frequent keys are known from every 16th set: they pass
    without the shuffle, which changes the way and not the result.
    """
    rows = sets.select("nid", "n", F.explode("keys").alias("key"))
    some = rows.where(F.pmod(F.xxhash64("nid"), F.lit(16)) == 0).groupBy("key").agg(F.count("*").alias("count"))
    heavy = heavy_keys(some, "key", "count", 2000)
    hot = F.col("key").isin(heavy) if heavy else F.lit(False)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _, _ in whole_groups(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "nid", "n"])

    usual = rows.where(~hot).select("key", "nid", "n").repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, nid long, n long")
    return usual.unionByName(rows.where(hot).select("key", "nid", "n")) if heavy else usual


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the keys with more than ``block`` rows."""
    return rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")


def stars(shared: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) that link each set to one of a fitting size that shares the most keys with others: one guess a set at most.

    Of near copies the text that the others were made from shares the most, so most guesses of a dense class are right.
    """
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"))
    sizes = written(sizes, "sizes")
    each = spread_join(shared, sizes.hint("merge"), "key", "inner", heavy_keys(sizes, "key", "size"))
    degree = each.groupBy("nid").agg(F.sum("size").alias("degree"))
    cut = meet(shared, written(degree, "degrees"), "nid").join(written(blocks_of(shared, block), "hot"), "key", "left")
    cut = cut.withColumns({"x": F.pmod(F.xxhash64("nid", "key"), F.coalesce("blocks", F.lit(1))).cast("int"), "after": -F.col("degree")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, nid, n), starts, ends in whole_groups(batches, 2):
            group, centre = np.repeat(np.arange(len(starts)), ends - starts), np.full(len(n), -1)
            while len(rest := np.flatnonzero(centre < 0)):  # the first that has none is the next centre of its group
                first = rest[np.unique(group[rest], return_index=True)[1]]
                own = first[np.searchsorted(group[first], group[rest])]
                fits = (percent * n[rest] <= 100 * n[own]) & (percent * n[own] <= 100 * n[rest])
                centre[rest[fits]] = own[fits]
            pairs, times = np.unique(np.stack((nid, nid[centre]))[:, nid != nid[centre]], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(times)], names=["nid", "centre", "times"])

    dealt = cut.select("key", "x", "after", "nid", "n").repartition("key", "x").sortWithinPartitions("key", "x", "after", "nid")
    found = dealt.mapInArrow(run, "nid long, centre long, times long").groupBy("nid", "centre").agg(F.sum("times").alias("times"))
    best = found.groupBy("nid").agg(F.max(F.struct("times", "centre")).alias("best"))
    return best.select(F.least("nid", "best.centre").alias("a"), F.greatest("nid", "best.centre").alias("b")).distinct()


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sorted join at every size: it spills where it must, and a table that happens to be small doesn't change the plan."""
    return left.join(right.hint("merge"), on, how)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, most: int = 2000) -> DataFrame:
    """The pairs (a, b) of sets (nid, shingles) that have this similarity, counted exactly. A set of very many pairs is copied to as many tasks as they need."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("copies"))
    left = meet(sets.withColumnRenamed("nid", "a"), copies, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("x"))
    dealt = meet(pairs, copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).select("a", "b", "copy")
    both = meet(meet(dealt, sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y")), "b"), left, ["a", "copy"])
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


class Sketches:
    """The sketches of a chunk of rows, of several widths; pairs are compared at the width of the narrower one."""

    def __init__(self, held: pa.Array):
        self.offsets = held.offsets.to_numpy().astype(np.int64)
        self.offsets -= self.offsets[0]
        self.flat, self.width = held.flatten().to_numpy().view(np.uint64), np.diff(self.offsets)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def folded(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row its place in the matrix of rows of ``w`` words, and that matrix; narrower rows have no place."""
        if w not in self.at:
            wide = np.flatnonzero(self.width >= w)
            rows = np.empty((len(wide), w), np.uint64)
            for v in np.unique(self.width[wide]).tolist():
                mine = np.flatnonzero(self.width[wide] == v)
                rows[mine] = folded(self.flat[self.offsets[wide[mine]][:, None] + np.arange(v)], w)
            place = np.full(len(self.width), -1)
            place[wide] = np.arange(len(wide))
            self.at[w] = place, rows
        return self.at[w]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of rows i and j differ."""
        out, width = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            place, rows = self.folded(w)
            at = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // w)
            for s in range(0, len(at), step):
                k = at[s : s + step]
                out[k] = np.bitwise_count(rows[place[i[k]]] ^ rows[place[j[k]]]).sum(axis=1, dtype=np.int64)
        return out


def open_pairs(shared: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int, block: int, every: bool) -> DataFrame:
    """Pairs (a, b) of sets that share a key, are not joined yet (roots differ), and may be similar by size and by sketch.

    Two sketches differ in at most as many bits as the sets in tokens. Without ``every`` only pairs leave a group that span
    its roots as far as such pairs join them, those of the nearest sketches first, and a row (again: the key) says where there
    were others. Only keys with several roots are looked at; those with more than ``block`` rows are cut into blocks of
    which every two are a group.
    """
    rows = meet(shared, roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = written(meet(rows, several, "key", "left_semi"), "open")
    cut = rows.join(written(blocks_of(rows, block), "hot"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = meet(cut.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "nid", "n", "root"), sketches, "nid")
    columns = ["key", "x", "y", "n", "nid", "own", "root", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y, n, nid, own, root, held), starts, ends in whole_groups(batches, 3, 4096):
            bits_of, found = Sketches(held), [np.zeros((3, 0), np.int64)]
            for i, j in pair_blocks(starts, ends):
                fits = (root[i] != root[j]) & (percent * n[j] <= 100 * n[i]) & (percent * n[i] <= 100 * n[j]) & ((x[i] == y[i]) | (own[i] != own[j]))
                i, j = i[fits], j[fits]
                bits = bits_of.apart(i, j)
                near = bits * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
                found.append(np.stack((i[near], j[near], bits[near])))
            a, b, bits = np.concatenate(found, axis=1)
            again = np.zeros(0, np.int64)
            if len(a) and not every:
                group = np.repeat(np.arange(len(starts)), ends - starts)
                label = np.unique(np.stack((group, root)), axis=1, return_inverse=True)[1].reshape(-1)  # a root in each group by itself
                at = spanning(label[a], label[b], bits)
                left = np.bincount(group[a], minlength=len(starts)) > np.bincount(group[a[at]], minlength=len(starts))
                again, a, b = key[starts[left]], a[at], b[at]
            pairs = np.unique(np.sort(np.stack((nid[a], nid[b])), axis=0), axis=1)
            none = np.zeros(pairs.shape[1], bool), np.ones(len(again), bool)
            both = lambda p, q: pa.array(np.concatenate((p, q)), mask=np.concatenate(none))  # noqa: B023, E731
            keys = pa.array(np.concatenate((np.zeros(pairs.shape[1], np.int64), again)), mask=~np.concatenate(none))
            yield pa.RecordBatch.from_arrays([both(pairs[0], again), both(pairs[1], again), keys], names=["a", "b", "again"])

    dealt = cut.select(*columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(run, "a long, b long, again long")


def with_sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(nid, sketch) of each (nid, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [signed(sketch(s.values.to_numpy().view(np.uint64), percent)) for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["nid", "sketch"])

    return sets.select("nid", "shingles").mapInArrow(run, "nid long, sketch array<bigint>")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the size of its set of shingles and the least id that links reach.

    A row's set are its distinct shingles of ``words`` words (A-Z lower-cased; fewer words are one shingle), as 64-bit
    hashes. Rows link where 100 * intersection >= ``percent`` * union; no pair is left out:

    1. Equal sets are one node. Every set gives the keys of its sketch's segments in the bands of its size, and two
       similar sets share one (``join_keys``).
    2. Each set is first linked to one that shares the most keys (``stars``), these pairs are counted exactly, and the
       components of the true links found. So a class of very many near copies costs pairs in proportion to its size.
    3. All pairs of a key that are still apart are compared by size and by parity sketch. Of those that may be similar
       first the nearest that span a key's components are counted exactly, then all that are left between
       components. The components of all true links are the classes.

    Texts are read twice: for keys, and for the sets that share a key with another (picked by a sieve of their rows);
    only keys, sketches and these sets are shuffled. Rows without words (null, empty, white space) have an empty set and link with nothing, not with
    each other either. A null id is never the least of others, and the class of null ids alone is null; rows that
    repeat an id are rows of their own in one class if their sets are linked. An empty table gives no rows. Other
    columns are not read.
    """
    since, spark = tables_so_far(), docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("body"))
    own = written(with_keys(source, words, percent), "sets")
    firsts = own.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first(F.struct("row", "n", "keys")).alias("r"), F.count("*").alias("times"))
    nodes = written(firsts.select("node", "least", "times", "r.*", F.monotonically_increasing_id().alias("nid")), "nodes")
    own = written(own.drop("keys"), "rows")
    release(spark)
    shared = written(postings(nodes), "postings")
    nodes = written(nodes.drop("keys"), "members")
    forget(spark, since, "rows", "postings", "members")
    guesses = written(stars(shared, percent, block), "stars")
    asked = written(meet(nodes, shared.select("nid").distinct(), "nid", "left_semi").select("row", F.col("nid").alias("node")), "asked")
    wanted = sieve(asked, "row")
    bodies = meet(source.where(wanted("row")).select("row", "body"), asked, "row").dropDuplicates(["node"])
    sets = written(shingle_sets(bodies, words).withColumnRenamed("node", "nid"), "shingles")
    release(spark)
    sketches = written(with_sketches(sets, percent), "sketches")
    tried, links = guesses, written(verified(guesses, sets, percent), "links")
    roots = components(links).withColumnsRenamed({"node": "nid"})
    for every in (False, True):
        found = written(open_pairs(shared, roots, sketches, percent, block, every), "open_pairs")
        release(spark)
        further = written(found.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "further")
        shared = meet(shared, found.where("again is not null").select(F.col("again").alias("key")).distinct(), "key", "left_semi")
        tried = tried.unionByName(further)
        more = written(verified(further, sets, percent), "more")
        release(spark)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links).withColumnsRenamed({"node": "nid"})
    placed = nodes.select("nid", "node", "least").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
    named = written(spread_join(placed, least, "root", "inner", heavy_keys(sizes, "root", "size")).select("node", "component"), "named")
    forget(spark, since, "rows", "members", "named")
    per = nodes.select("node", "times")
    out = spread_join(own.select("id", "node", "n"), named, "node", "left", heavy_keys(per, "node", "times"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op12_parity(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of 5-word shingles and the least doc_id that links of 0.8 or more reach."""
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w
), named AS (
  SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'row ' || rid END AS node FROM sets
), nodes AS (
  SELECT node, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS least FROM named GROUP BY node
), grams AS (
  SELECT node, n, md5_number(g) AS g FROM (SELECT node, n, unnest(s) AS g FROM nodes)
), links AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT node AS a, node AS b FROM nodes
  UNION
  SELECT reach.a, CASE WHEN links.a = reach.b THEN links.b ELSE links.a END FROM reach JOIN links ON reach.b = links.a OR reach.b = links.b
), least AS (
  SELECT reach.a AS node, min(least) AS component_id FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY reach.a
)
SELECT doc_id, n::bigint AS n_shingles, component_id FROM named JOIN least USING (node)
"""

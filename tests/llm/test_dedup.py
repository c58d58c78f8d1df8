"""SimHash classes, substring removal and components against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reelmill.llm import simhash, substrings
from reelmill.llm.common import mix, sieve
from reelmill.llm.components import components


def fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= distance:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {v: top(v) for v in values}


def test_query_matches_brute_force(spark, docs, folder):
    got = simhash.op3_simhash(spark, folder).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    root = classes({f for _, f in prints}, 3)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    expected = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in prints), key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == expected


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest("a b c", seed=42)


def linked(spark, values, distance, **more):
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) * 2 for v in values], "node long, fp long")
    links = simhash.near_links(df, distance, **more)
    joined = components(links)
    found = {int(np.int64(r.node).astype(np.uint64)): r.root for r in joined.collect()}
    return found, links.count()


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(3)
    for distance in (3, 9):
        centres = [rng.getrandbits(64) for _ in range(25)]
        near = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance))) for c in centres for _ in range(8)]
        far = [c ^ sum(1 << b for b in rng.sample(range(64), distance + 1)) for c in centres]
        values = sorted({*centres, *near, *far})
        root = classes(values, distance)
        found, _ = linked(spark, values, distance, block=16)
        same = {}
        for v in values:
            same.setdefault(root[v], set()).add(found.get(v, v))
        assert all(len(x) == 1 for x in same.values())
        assert len({next(iter(x)) for x in same.values()}) == len(same)


def test_a_dense_class_gives_few_links(spark):
    values = [(1 << 63) - 1 ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)]
    found, n = linked(spark, values, 3)
    assert len(set(found.values())) == 1 and n < 100 * len(values)


def test_pairs_too_different_in_size_are_not_compared(spark, monkeypatch):
    """All rows share the keys of one segment: what is compared of their pairs is what the size bound lets through."""
    rng = random.Random(8)
    values = [rng.getrandbits(48) << 16 for _ in range(1200)]
    values += [v ^ 3 << 40 for v in values[:100]]
    n = [int(10 ** rng.uniform(1, 4)) for _ in values[:1200]]
    rows = [(i, int(np.uint64(v).astype(np.int64)), (n + n)[i]) for i, v in enumerate(values)]
    held = {}
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: held.update(run=run, rows=self.toArrow()))
        simhash.near_links(spark.createDataFrame(rows, "node long, fp long, n long"), 11, similarity=0.8)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
    found = {(a, b) for batch in held["run"](iter(held["rows"].to_batches())) for a, b in zip(*(c.to_pylist() for c in batch.columns))}
    assert found >= {(i, 1200 + i) for i in range(100) if n[i] == (n + n)[1200 + i]}
    assert sum(compared) < 17 * len(rows) ** 2 / 2 / 4


def test_near_pairs_match_brute_force():
    rng = np.random.default_rng(3)
    for similarity, spread in ((0.8, 8), (0.8, 1), (0.0, 8)):
        size = rng.choice([2, 3, 40, 150, 400], 12)
        ends, starts = np.cumsum(size), np.cumsum(size) - size
        n = np.concatenate([np.sort(np.exp(rng.uniform(0, spread, k)).astype(np.int64)) for k in size])
        fp = rng.integers(0, 2**63, 5).astype(np.uint64)[rng.integers(0, 5, ends[-1])]
        for _ in range(9):
            fp = fp ^ np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
        fits = lambda i, j: similarity * np.maximum(n[i], n[j]) <= np.minimum(n[i], n[j])
        expected, got = set(), []
        for i, j in simhash.pair_blocks(starts, ends):
            at = (np.bitwise_count(fp[i] ^ fp[j]) <= 11) & fits(i, j)
            expected |= set(zip(i[at].tolist(), j[at].tolist()))
        for few in (8, 64, 1000):
            got = [np.stack(x)[:, fits(*x)] for x in simhash.near_pairs(starts, ends, fp, n, 11, similarity, few)]
            pairs = [p for x in got for p in zip(*x.tolist())]
            assert len(pairs) == len(set(pairs)) and set(pairs) == expected and expected


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_near_dedup_keeps_one_of_each(spark, docs, empty):
    kept = simhash.near_dedup(docs.withColumns({"fingerprint": F.lit(1), "tie_x": F.lit(2)}))
    assert kept.columns == [*docs.columns, "fingerprint", "tie_x"]
    rows = kept.collect()
    assert [r.doc_id for r in rows if r.doc_id and 100 <= r.doc_id < 200] == [100]
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert simhash.near_dedup(empty).count() == 0


def test_near_dedup_of_edited_texts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(12):
        words = [f"w{rng.randint(0, 999)}" for _ in range(400)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(400)] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(12)]


def near_prints(a, b, distance):
    low, high = sorted((x ^ y).bit_count() for x, y in zip(a, b))
    return low <= distance and high <= 2 * distance


def near_kept(texts, distance=11, similarity=0.8):
    """Ids that near_dedup keeps, by all pairs."""
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    prints = [(simhash.simhash(s), simhash.simhash(mix(s))) for s in sets]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near_prints(prints[i], prints[j], distance):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return sorted(set(root))


def around_the_threshold():
    rng = random.Random(12)
    texts = []
    for rate in (0.012, 0.013, 0.014):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(f"e{rng.randrange(10**9)}" if rng.random() < rate else w for w in base) for _ in range(120)]
    return texts


def test_near_dedup_around_the_threshold(spark):
    texts = around_the_threshold()
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == near_kept(texts)


def similar_classes(sets, similarity):
    """Classes by all pairs of this similarity, whatever the fingerprints; and those pairs."""
    root, pairs = list(range(len(sets))), []
    for i in range(len(sets)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    pairs.append((i, j))
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    return root, pairs


def test_recall_over_all_pairs_of_edited_texts(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(100):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randint(60, 500))]
        for _ in range(6):
            rate = rng.uniform(0.0, 0.025)
            texts.append(" ".join(f"e{rng.randrange(10**9)}" if rng.random() < rate else w for w in base))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    root, pairs = similar_classes(sets, 0.8)
    prints = [(simhash.simhash(s), simhash.simhash(mix(s))) for s in sets]
    direct = sum(near_prints(prints[i], prints[j], 11) for i, j in pairs) / len(pairs)
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted(r.doc_id for r in kept.collect())
    assert got == near_kept(texts)
    removed = len(texts) - len(set(root))
    assert direct >= 0.9 and len(texts) - len(got) >= 0.97 * removed and set(root) <= set(got)


def test_open_links_in_blocks(spark):
    texts = around_the_threshold()[100:260]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)).view(np.int64).tolist() for t in texts]
    half = lambda h: int(np.uint64(simhash.simhash(h)).astype(np.int64))
    hashes = [np.array(s).view(np.uint64) for s in sets]
    nodes = spark.createDataFrame([(half(h), half(mix(h)), i, i, len(h)) for i, h in enumerate(hashes)], "fp long, twin long, node long, root long, n long")
    found = simhash.open_links(nodes, spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<bigint>"), 0.8, 11, block=16)
    joined = {r.node: r.root for r in components(found).collect()}
    assert sorted({joined.get(i, i) for i in range(len(texts))}) == near_kept(texts)


def test_near_dedup_of_texts_with_a_frequent_line(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = words(7)
    texts = [f"{words(100)} {' '.join([line] * 40)}" for _ in range(8)]
    texts += [f"{texts[0]} {' '.join([line] * 30)}"]  # the same set
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8)) == near_kept(texts)


def test_equal_fingerprints_are_checked(spark):
    sets = [list(range(0, 100)), list(range(1000, 1100)), list(range(5, 105)), list(range(1003, 1103))]
    nodes = spark.createDataFrame([(77, 78, i, i, 100) for i in range(4)], "fp long, twin long, node long, root long, n long")
    found = simhash.open_links(nodes, spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<bigint>"), 0.8, 11)
    assert sorted((r.a, r.b) for r in found.collect()) == [(0, 2), (1, 3)]


def test_a_sieve_lets_no_key_through_unseen(spark):
    keys = spark.range(0, 30000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(30000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key string, id long"))
    for most, share in ((1 << 28, 0.02), (1 << 16, 0.2), (1 << 7, 1.0)):
        hit = {r.id for r in rows.where(sieve(keys, "key")("key")).collect()}
        wrong = hit - set(range(0, 30000, 3))
        assert hit >= set(range(0, 30000, 3)) and len(sieve_hits(rows, keys, most) - set(range(0, 30000, 3))) <= share * 20002 and len(wrong) < 400
    assert rows.where(sieve(keys.limit(0), "key")("key")).count() == 0


def sieve_hits(rows, keys, most):
    hit = {r.id for r in rows.where(sieve(keys, "key", most)("key")).collect()}
    assert hit >= set(range(0, 30000, 3))
    return hit


def removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    where = {}
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            where.setdefault(tuple(w[p : p + window]), []).append((i, p))
    gone = [set() for _ in words]
    for found in where.values():
        if len(found) > 1:
            for i, p in found:
                gone[i].update(range(p, p + window))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in g)).hexdigest()) for w, g in zip(words, gone)]


def test_substring_query_matches_brute_force(spark, docs, folder):
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(((r.doc_id, *x) for r, x in zip(rows, removed([r.text for r in rows], 35))), key=str)
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op7_substrings(spark, folder).collect()], key=str)
    assert got == expected and sum(x[2] for x in got) > 0


def test_removal_with_many_contexts_and_small_shards(spark):
    rng = random.Random(4)
    for letters, window, sizes in (("ab", 9, {"reference": 3, "broadcast": 0}), ("abcdefgh", 10, {"reference": 3, "broadcast": 0}), ("ab", 9, {}), ("abcdefgh", 10, {"broadcast": 0})):
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(60)]
        core = " ".join(rng.choice("xyz") for _ in range(window + 3))
        texts += [f"{rng.choice(letters)} {rng.choice(letters)} {core} {' '.join(rng.choice(letters) for _ in range(6))}" for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in substrings.remove_repeats(df, window=window, **sizes).collect()}
        for i, (n, gone, sha) in enumerate(removed(texts, window)):
            assert hashlib.sha256(" ".join(got[i].split()).encode()).hexdigest() == sha, (i, n, gone)


def test_rows_grow_with_the_contexts_of_a_passage(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    core = words(40)
    texts = [f"{words(30)} {core} {words(30)}" for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    segments = substrings.segment_rows(df.select(F.unhex(F.md5("text")).alias("uid"), "text", anchors_of(texts[:1]).alias("wanted"), F.lit(1).cast("long").alias("times")), 35, True)
    counted = segments.groupBy("anchor", "seg").agg(F.first("body").alias("body"), F.sum("times").alias("times"))
    n, contexts = counted.count(), counted.groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert contexts > substrings.REFERENCE and n < 4 * len(texts)
    assert substrings.matched(counted, 35, substrings.REFERENCE).count() <= n
    got = {r.doc_id: r.text.split() for r in substrings.remove_repeats(df, broadcast=0).collect()}
    assert all(got[i] == t.split()[:30] + t.split()[70:] for i, t in enumerate(texts))


def anchors_of(texts):
    found = {int(a) for t in texts for a in substrings.anchors(t.encode().split(), 35)[0].view(np.int64)}
    return F.array(*[F.lit(a) for a in sorted(found)])


def test_removal_keeps_columns_and_white_space(spark, docs, empty):
    out = substrings.remove_repeats(docs.withColumn("uid_x", F.lit(7)))
    assert out.columns == [*docs.columns, "uid_x"] and out.count() == docs.count()
    rows = {r.doc_id: r.text for r in out.collect()}
    assert "\n" in rows[3] and rows[200] is None and rows[201] == "" and rows[202] == " \t\n "
    assert substrings.remove_repeats(empty).count() == 0

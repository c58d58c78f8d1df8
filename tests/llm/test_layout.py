"""Sharding, packing and winnowing against brute force and their laws."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from reelmill.llm import packing, sharding, winnowing


def test_shards_are_even_in_rows_and_mixture(spark, docs, empty):
    big = docs.select("doc_id", "text", "source").unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source")))
    rows = sharding.interleave(big.withColumn("key", F.lit(1)), 7, seed=3).collect()
    texts = Counter((r.doc_id, r.text) for r in big.collect())
    assert len(rows) == sum(texts.values())
    per = Counter(r.shard for r in rows)
    assert set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    for source, n in Counter(r.stratum for r in rows).items():
        found = Counter(r.shard for r in rows if r.stratum == source)
        assert max(found[s] for s in range(7)) - min(found[s] for s in range(7)) <= 2, (source, n)
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    for (d, t), _ in texts.items():
        assert sizes[d] == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sharding.interleave(empty, 7).count() == 0


def test_sharding_runs_without_python(spark, folder):
    for df in (sharding.op2_sharding(spark, folder), winnowing.op8_winnowing(spark, folder)):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def slow_best_fit(items, capacity):
    bins = []
    for length, s, c in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= length and s not in b["s"] and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        yield i, capacity - bins[i]["left"]
        bins[i]["left"] -= length
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)


def test_best_fit_finds_the_tightest_compatible_bin():
    rng = random.Random(1)
    for _ in range(30):
        items = [(rng.randint(0, 50), rng.randint(0, 4), rng.randint(0, 30)) for _ in range(120)]
        assert packing.best_fit(items, 50) == list(slow_best_fit(items, 50))


def test_every_document_is_packed_once_without_conflicts(spark, docs, empty):
    rows = packing.packed(docs.withColumn("pack", F.lit(0)), 256).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    texts = docs.collect()
    assert sum(lengths.values()) == sum(len(r.text or "") for r in texts) and set(lengths) == {r.doc_id for r in texts}
    source = {r.doc_id: r.source for r in texts}
    bins = {}
    for r in rows:
        bins.setdefault((r.pack, r.bin), []).append(r)
    for members in bins.values():
        assert len({source[r.doc_id] for r in members}) == len(members)
        at = 0
        for r in sorted(members, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.packed(empty).count() == 0


def test_packing_query_matches_best_fit_in_every_pack(spark, docs, folder):
    rows = packing.op4_packing(spark, folder).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    packs = {}
    for r in rows:
        packs.setdefault(r.pack, []).append(r)
    seen = Counter((r.doc_id, r.piece) for r in rows)
    assert seen == Counter((r.doc_id, i) for r in docs.collect() for i in range(max(1, -(-len(r.text or "") // 8192))))
    for members in packs.values():
        rests = sorted((r for r in members if r.length < 8192), key=lambda r: (-r.length, r.doc_id is None, r.doc_id or 0, r.piece))
        expected = list(slow_best_fit([(r.length, source[r.doc_id], text[r.doc_id]) for r in rests], 8192))
        assert [(r.bin, r.offset) for r in rests] == expected or Counter(seen.values()).most_common()[0][0] > 1 and sorted((r.bin, r.offset) for r in rests) == sorted(expected)


def test_repeated_rows_are_dealt_to_several_packs(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "same", "s") for i in range(300)] + [(i, f"t{i}", "s") for i in range(100, 140)], "doc_id long, text string, source string")
    rows = packing.pack(df.select("doc_id", F.lit(4).alias("length"), "source", F.xxhash64("text").alias("cluster")), 64, rows=40).collect()
    sizes = Counter(r.pack for r in rows)
    assert len(rows) == 340 and len(sizes) > 4 and max(sizes.values()) < 100
    assert len({(r.pack, r.bin) for r in rows}) == 340  # one source: no two share a bin


def test_many_small_strata_spread_over_the_ranks(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"))
    rows = sharding.interleave(df, 8).collect()
    assert set(Counter(r.shard for r in rows).values()) == {500}
    assert {r.doc_id for r in rows} == set(range(4000))


def windows(tokens, k, w):
    grams = [tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []
    return grams, [grams[i : i + w] for i in range(max(1, len(grams) - w + 1))] if grams else []


def test_winnowing_guarantee_and_rightmost_ties(spark, docs):
    rows = winnowing.winnow(docs.where("doc_id is not null"), "text", "m").select("text", "m").collect()
    for r in rows:
        tokens = winnow_tokens(r.text or "")
        grams, spans = windows(tokens, 4, 8)
        places = [m.position for m in r.m]
        assert places == sorted(places) and (not grams) == (not places)
        by = {m.position: m.hash for m in r.m}
        for i, span in enumerate(spans):  # every window holds a mark, none of it to the right of an equal gram in the window
            inside = [p for p in places if i <= p < i + len(span)]
            assert inside
            best = min(inside, key=lambda p: (by[p], -p))
            assert not any(g == grams[best] for g in grams[best + 1 : i + len(span)])


def winnow_tokens(text):
    import re

    u = "฀-໿ក-៿぀-鿿가-힯"
    return re.findall(f"[{u}]|[^ \t-\r{u}]+", text)


def slow_marks(text, k, window):
    """Hash and position of the window minima, one window after the other."""
    x = [(h - (h >> 63 << 64)) % winnowing.PRIME for h in (xxhash.xxh64_intdigest(t.encode(), 42) for t in winnow_tokens(text))]
    if not x:
        return []
    runs = [x[i : i + k] for i in range(max(1, len(x) - k + 1))]
    grams = [sum(v * pow(winnowing.BASE, k - 1 - j, winnowing.PRIME) for j, v in enumerate(r)) % winnowing.PRIME for r in runs]
    found = []
    for i in range(max(1, len(grams) - window + 1)):
        span = grams[i : i + window]
        best = max(j for j, h in enumerate(span) if h == min(span)) + i
        if not found or found[-1][1] != best:
            found.append((grams[best], best))
    return found


@pytest.mark.parametrize(("k", "window"), [(4, 8), (1, 1), (3, 5), (7, 4), (2, 1)])
def test_marks_match_a_slow_version(spark, docs, k, window):
    rows = winnowing.winnow(docs.withColumn("marks", F.lit(1)), k=k, window=window).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(m.hash, m.position) for m in r.marks_] == slow_marks(r.text or "", k, window) and r.marks == 1


def slow_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("partitions", [1, 16, 300])
def test_fingerprints_of_edited_and_next_texts(spark, tmp_path, partitions):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aeiost") for _ in range(5)) for _ in range(rng.randint(0, 80))) for _ in range(380)] + ["", None, "é" * 7]
    ids = [*range(len(texts)), None, None, 7, 7]
    texts += ["a null id", "another null id with words", texts[7], "another text of id seven"]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnowing.op8_winnowing(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((i, t or "") for i, t in zip(ids, texts)), key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    digest = lambda m: hashlib.md5(",".join(str(h << 32 | (2**32 - 1 - p)) for h, p in m).encode()).hexdigest()
    expected = Counter()
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        mine, theirs, following = (slow_marks(x, 4, 8) for x in (t, edited, after))
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(mine), digest(theirs), round(slow_likeness(mine, theirs), 9), round(slow_likeness(mine, following), 9)] += 1
    assert got == expected


def test_fingerprints_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert winnowing.op8_winnowing(spark, str(tmp_path)).count() == 0

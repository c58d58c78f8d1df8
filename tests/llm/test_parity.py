"""The Jaccard join against all pairs, and its bounds against random sets."""

import random

import numpy as np
import pytest

from reelmill.llm import parity, simhash


def slow(rows, words=5, percent=80):
    """(id, size, least id reached) of (id, text) by all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").encode().lower().split()]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and root[i] != root[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, node int")
    return sorted(map(tuple, parity.similar_classes(df, **more).collect()), key=str)


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [w, f"n{rng.randrange(10**9)}"] if x < 2 * rate / 3 else [f"e{rng.randrange(10**9)}"] if x < rate else [w]
    return out


def around_the_threshold(rng, bases, each, sizes, shared=()):
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(*sizes))]
        for _ in range(each):
            rows.append((len(rows), " ".join([*edited(rng, base, rng.uniform(0.0, 0.06)), *shared])))
    return rows


def random_sets(rng, n, percent, within):
    """Two sets, the first of n tokens, just within or just beyond the similarity."""
    a = {rng.getrandbits(64) for _ in range(n)}
    b = set(a)
    while True:
        c = set(b)
        if rng.random() < 0.5 and len(c) > 1:
            c.discard(rng.choice(sorted(c)))
        else:
            c.add(rng.getrandbits(64))
        if 100 * len(a & c) < percent * len(a | c):
            return a, b if within else c
        b = c


def test_similar_sets_share_a_key_and_sketches_bound_their_difference():
    rng = random.Random(2)
    tokens = lambda s: np.array(sorted(s), np.uint64)
    for n in [*range(1, 40), *(rng.randint(40, 700) for _ in range(60))]:
        for percent in (80, 95, 60):
            a, b = (tokens(s) for s in random_sets(rng, n, percent, True))
            assert len(a) == len(b) and (a == b).all() or set(parity.join_keys(a, percent)) & set(parity.join_keys(b, percent)), (n, percent)
            x, y = parity.sketch(a, percent), parity.sketch(b, percent)
            w = min(len(x), len(y))
            apart = int(np.bitwise_count(parity.folded(x[None], w) ^ parity.folded(y[None], w)).sum())
            assert apart <= len(np.setxor1d(a, b)) <= parity.most_apart(len(a), len(b), percent)


def test_sets_with_few_filled_segments_still_meet(monkeypatch):
    """With one way of dealing alone, the keys of empty segments must do."""
    rng = random.Random(7)
    monkeypatch.setattr(parity, "SEEDS", 1)
    for n in range(4, 14):
        for _ in range(60):
            a, b = (np.array(sorted(s), np.uint64) for s in random_sets(rng, n, 80, True))
            assert set(a) == set(b) or set(parity.join_keys(a, 80)) & set(parity.join_keys(b, 80))


@pytest.mark.parametrize(("sizes", "words", "percent"), [((3, 160), 5, 80), ((30, 60), 2, 60)])
def test_classes_match_all_pairs(spark, sizes, words, percent):
    rows = around_the_threshold(random.Random(11), 20, 14, sizes)
    assert found(spark, rows, words=words, percent=percent) == slow(rows, words, percent)


def test_families_that_share_a_passage_in_blocks(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(200)]
    rows = around_the_threshold(rng, 50, 2, (40, 60), passage)
    rows += [(1000 + i, " ".join(edited(rng, passage, 0.02))) for i in range(60)]
    expected = slow(rows)
    assert found(spark, rows, block=16) == expected
    assert 20 < len({r[2] for r in expected}) < len(rows)


def test_odd_rows(spark, docs, folder, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, parity.op12_parity(spark, folder).collect()), key=str) == slow(rows)
    more = [(1, "A b C"), (2, "a B c"), (2, "a b c d"), (None, "x y"), (None, "X Y"), (None, None), (3, ""), (4, " \t"), (5, None), (5, "z z z z z z z z z"), (6, "z z z z z z"), (7, "a b"), (None, "a b")]
    assert found(spark, more) == slow(more)
    assert parity.similar_classes(empty).count() == 0


def test_a_dense_class_gives_few_pairs(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        own = list(base)
        own[rng.randrange(120)] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    nodes = spark.createDataFrame([(i, len(s), parity.join_keys(s, 80).view(np.int64).tolist()) for i, s in enumerate(sets)], "nid long, n long, keys array<bigint>")
    shared = parity.postings(nodes)
    guesses = parity.stars(shared, 80, 4096).collect()
    right = sum(100 * len(set(sets[r.a]) & set(sets[r.b])) >= 80 * len(set(sets[r.a]) | set(sets[r.b])) for r in guesses)
    assert len(guesses) <= len(texts) and right == len(guesses)

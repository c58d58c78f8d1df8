"""Hard negatives against all pairs in Python integers, and the query against its SQL."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from reelmill.llm import negatives
from reelmill.llm.common import LONG, cut_score, whole_score

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS = "vec_id long, embedding array<double>, label string, rank int"


def slow(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """All pairs; rows of (vec_id, vector, label)."""
    own = []
    for i, (vec_id, v, label, *_) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            own.append((i, vec_id, [math.floor(256 * x) for x in v], label))
    cut = lambda n: max(-LONG - 1, min(LONG, n))
    out = []
    for i, a, v, label in own:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), b is None, b or 0, j, other) for j, b, w, other in own if j != i and len(w) == len(v))
        near = [s for s in scored if s[4] == label][:positives]
        for p in near:
            fits = [s for s in scored if s[4] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(a, None if p[1] else p[2], n, None if s[1] else s[2], cut(-p[0]), cut(-s[0])) for n, s in enumerate(fits[:negatives], 1)]
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    return [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()]


def test_numbers_of_any_size_keep_their_order():
    numbers = sorted({0, 5, -5, LONG - 1, LONG, LONG + 1, -LONG, -LONG - 1, -LONG - 2, 10**30, -(10**30), 10**300, 10**301, -(10**301), 255 * 256**9, 256**10})
    keys = [cut_score(n) for n in numbers]
    assert [whole_score(*k) for k in keys] == numbers
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or b""))


@pytest.mark.parametrize("size", [1.0, 1e4, 1e8, 1e30, 1e160, 1e300])
def test_scores_of_all_sizes(spark, size):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0.3, 1) * (size if rng.random() < 0.5 else 1.0) for _ in range(4)]
    rows = [(i, vector(), rng.choice("abc"), 0) for i in range(120)]
    assert sorted(mined(spark, rows)) == sorted(slow(rows, lambda a: a % 10 == 0))


def test_odd_rows_and_several_passes(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)], rng.choice("ab"), 0) for i in range(150)]  # many ties
    rows += [(10, list(rows[20][1]), "a", 0), (10, list(rows[10][1]), rows[10][2], 0), (None, [1.0, 1.0, 1.0], "a", 0), (None, [0.5, 0.5, 0.25], "b", 0), (LONG, [0.5, 0.5, 0.25], "b", 0)]
    rows += [(200, None, "a", 0), (210, [1.0, None, 0.0], "a", 0), (220, [1.0, math.nan, 0.0], "a", 0), (230, [math.inf, 0.0, 0.0], "a", 0), (240, [1e308, 1.0, 1.0], "a", 0), (250, [1.0, 1.0, 1.0], None, 0)]
    rows += [(260, [1.0, 2.0], "a", 0), (261, [1.0, 1.0], "a", 0), (262, [0.5, 0.5], "b", 0), (270, [], "a", 0), (271, [], "a", 0), (272, [], "b", 0), (280, [-1.0, -1.0, -1.0], "c", 0), (281, [9.0, 1.0, 1.0], "c", 0)]
    expected = slow(rows, lambda a: a is not None and a % 10 == 0)
    for more in ({}, {"pass_rows": 4, "pass_size": 9}, {"positives": 2, "negatives": 3, "low": 10, "high": 100}):
        wanted = expected if "low" not in more else slow(rows, lambda a: a is not None and a % 10 == 0, 2, 3, 10, 100)
        assert sorted(map(str, mined(spark, rows, **more))) == sorted(map(str, wanted)) and wanted
    assert mined(spark, []) == []


def test_blocks_of_anchors_and_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(8)], str(rng.randrange(3)), 0) for i in range(400)]
    anchors = negatives.Anchors(spark.createDataFrame([(i, r[2], r[1]) for i, r in enumerate(rows[:20])], "row long, label string, v array<double>").toArrow(), None, 1)
    assert anchors.n == 20 and list(anchors.by_dim) == [8]
    assert sorted(mined(spark, rows, blocks=(7, 11))) == sorted(slow(rows, lambda a: a % 10 == 0))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    found = con.execute(negatives.OP13_SQL)
    names = [c[0] for c in found.description]
    assert sorted(tuple(r) for r in negatives.op13_negatives(spark, DIR).select(*names).collect()) == sorted(found.fetchall())

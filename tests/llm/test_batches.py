"""What the pipeline sends to Python workers at once."""

import pyarrow as pa
import pytest

import corpus_pipeline
from reelmill.llm import substrings

KEY = corpus_pipeline.BATCH_BYTES[0]


@pytest.fixture
def unset(spark):
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield
    if before is None:
        spark.conf.unset(KEY)
    else:
        spark.conf.set(KEY, before)


def largest_batch(spark) -> int:
    """Bytes of the largest batch of 3,000 texts of 10 KB in one partition."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('words ', 1707) AS text")
    return texts.mapInArrow(sizes, "n long").groupBy().max("n").first()[0]


def test_a_stage_sends_small_batches(spark, empty, unset):
    corpus_pipeline.cut_repeats(spark, empty, "")
    assert largest_batch(spark) < 6_000_000  # 30 MB without it


def test_a_session_keeps_its_own_size(spark, empty, unset):
    spark.conf.set(KEY, "1m")
    corpus_pipeline.pack(spark, empty, "")
    assert spark.conf.get(KEY) == "1m"


def test_texts_without_repeats_are_not_shuffled_for_the_result(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50)) + ("\n" + passage if i < 3 else "")) for i in range(300)] + [(300, None), (301, ""), (None, "a b")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), broadcast=0)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "Join" not in plan.children().apply(0).toString()
    want = [(i, t.split("\n")[0] + "\n" if i is not None and i < 3 else t) for i, t in rows]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(out.collect()) == order(want)

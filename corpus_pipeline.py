"""A training corpus from ``documents``: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmill.llm import langid, packing, simhash, substrings, toxicity
from reelmill.llm.common import forget, tables_so_far, written
from reelmill.session import ship

#: Bytes of a batch that goes to a Python worker, where the session sets nothing else. Batches of 10,000 whole texts take
#: some 20 MB several times over in the executor and in each worker, and a worker keeps what it once took.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package's sources on the executors and small batches."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    return ship(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; nulls, repeated rows and empty tables as in ``langid.keep_identified``."""
    prepared(spark)
    return langid.keep_identified(docs)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; odd rows as in ``toxicity.keep_clean``."""
    prepared(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; odd rows as in ``simhash.near_dedup``."""
    prepared(spark)
    return simhash.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that also stand elsewhere; odd rows as in ``substrings.remove_repeats``."""
    prepared(spark)
    return substrings.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the sequences of the training set; odd rows as in ``packing.packed``."""
    prepared(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifiers and the suffix automata; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and its other tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = tables_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        forget(spark, since, name)
    return STAGES[-1][1](spark, docs, sf_dir)

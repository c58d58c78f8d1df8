"""Operator 5: toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import fresh

TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> set[str]:
    """The words of a text, and their beginnings of 4 and 5 letters (for inflected forms) with a mark."""
    words = set(TOKEN.findall(text.lower())) if text else set()
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words}


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """For each category a linear model over marker words and the probabilities of the categories before it."""

    def __init__(self, categories: list[str], vocabulary: list[str], weights: list[np.ndarray]):
        self.categories, self.weights = categories, weights
        self.index = {w: i for i, w in enumerate(vocabulary)}

    def predict(self, words: set[str]) -> list[float]:
        hits = [self.index[w] for w in words & self.index.keys()]
        earlier: list[float] = []
        for w in self.weights:
            k = len(self.index)
            z = w[hits].sum() + sum(a * b for a, b in zip(w[k : k + len(earlier)], earlier)) + w[-1]
            earlier.append(float(sigmoid(z)))
        return earlier


def fold_counts(texts: list[str | None], labels: np.ndarray, fold: np.ndarray, folds: int) -> tuple[list[list[Counter]], list[Counter]]:
    """For each fold: rows with each word among the positive rows of each category, and among all rows.

    Texts are cut into words anew on each pass, and only words seen in several positive rows are counted over
    all, so the driver never holds the words of all texts.
    """
    positive = [[Counter() for _ in range(labels.shape[1])] for _ in range(folds)]
    for t, row, f in zip(texts, labels, fold):
        if row.any():
            words = tokens(t)
            for j in np.flatnonzero(row):
                positive[f][j].update(words)
    wanted = {w for j in range(labels.shape[1]) for w, k in sum((p[j] for p in positive), Counter()).items() if k > 2}
    counts = [Counter() for _ in range(folds)]
    for t, f in zip(texts, fold):
        counts[f].update(tokens(t) & wanted)
    return positive, counts


def marker_words(positive: list[Counter], counts: Counter, bases: np.ndarray, most: int, least_rows: int = 8) -> list[str]:
    """The words most telling of any category: by the lower bound of their rate of positive rows, best first."""
    found: dict[str, float] = {}
    for seen, base in zip(positive, bases):
        for w, k in seen.items():
            n = counts[w]
            if k > 2 and n >= least_rows and (bound := k / n - 1.64 * np.sqrt((k / n * (1 - k / n) + 0.25 / n) / n)) > 2 * base:
                found[w] = max(found.get(w, 0.0), bound / max(base, 1e-9))
    return sorted(found, key=lambda w: (-found[w], w))[:most]


def fit_chain(texts: list[str | None], labels: np.ndarray, categories: list[str], most_words: int = 160, folds: int = 5, penalty: float = 0.2) -> tuple[Chain, np.ndarray]:
    """Fit the chain; also the out-of-fold predictions that its later models learnt from, a column a category.

    Row i is in fold i % ``folds``. For each fold the words (at most ``most_words``) and the weights come from the
    other folds' rows alone; the final models take words and weights from all rows.
    """
    fold = np.arange(len(texts)) % folds
    positive, counts = fold_counts(texts, labels, fold, folds)
    some = lambda parts: sum(parts, Counter())
    rate = lambda rows: labels[rows].mean(axis=0) if rows.any() else np.zeros(labels.shape[1])
    per_category = lambda leave: [some(positive[f][j] for f in range(folds) if f != leave) for j in range(labels.shape[1])]
    chosen = [marker_words(per_category(f), some(counts[g] for g in range(folds) if g != f), rate(fold != f), most_words) for f in (*range(folds), None)]
    index = {w: i for i, w in enumerate(sorted(set().union(*chosen)))}
    x = np.zeros((len(texts), len(index)), np.float32)
    for i, t in enumerate(texts):
        x[i, [index[w] for w in tokens(t) & index.keys()]] = 1
    columns = [[index[w] for w in words] for words in chosen]
    one, weights, earlier = np.ones((len(texts), 1)), [], np.zeros((len(texts), 0))
    for j in range(labels.shape[1]):
        y, out = labels[:, j].astype(float), np.zeros(len(texts))
        design = lambda f: np.hstack((x[:, columns[f]], earlier, one))  # noqa: B023, E731
        for f in range(folds):
            held = fold == f
            if held.any() and not held.all():
                d = design(f)
                out[held] = sigmoid(d[held] @ fit_linear(d[~held], y[~held], penalty))
        d = design(-1)
        weights.append(fit_linear(d, y, penalty) if len(texts) else np.append(np.zeros(d.shape[1] - 1), -9.0))
        earlier = np.hstack((earlier, out[:, None]))
    return Chain(categories, chosen[-1], weights), earlier


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, longest: int = 20000, most_words: int = 160) -> Chain:
    """Fit a chain on at most ``sample`` labelled rows, drawn by a hash of the id, with at most ``most_words`` words.

    ``categories`` are Boolean columns over ``labels``, in chain order. Only texts of at most ``longest``
    characters are drawn, so what the driver gathers for fitting has a bound; scoring reads whole texts. Labels
    of null ids are left out, null categories count as false, ids labelled or standing several times give a row
    each; without any labelled row every probability is near 0.
    """
    drawn = labels.where(F.col(id_col).isNotNull()).select(id_col, *[F.coalesce(c, F.lit(False)).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    drawn = drawn.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.where(F.length(text_col) <= longest).select(id_col, text_col).join(F.broadcast(drawn), id_col).orderBy(F.xxhash64(id_col)).limit(sample).toPandas()
    y = rows[[f"y{i}" for i in range(len(categories))]].to_numpy(np.int64)
    return fit_chain(rows[text_col].tolist(), y, list(categories), most_words)[0]


def predicted(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``out_col``: the probability of each category of the chain, in its order.

    Reads the whole text of every row; null and empty texts get the constants' probabilities; repeated rows
    get equal ones; an empty table gives none; an existing column of that name stays and the new one gets an
    underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # vocabulary and weights: bounded by fit_chain
    out_col = fresh(docs, out_col)
    at, names = docs.columns.index(text_col), [*docs.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            p = [own.predict(tokens(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.list_(pa.float64()))], names=names)

    return docs.mapInArrow(run, docs.withColumn(out_col, F.array(F.lit(0.0))).schema)


def label_categories() -> dict[str, Column]:
    """The chain over the label table: unfit text of any kind, toxic text, toxic text of low quality.

    The table has one toxicity label; the other two categories combine it with the quality label. What the chain
    gives ``toxic``: the probability of ``unfit`` tells it of junk of any kind, which the words of toxic rows alone
    don't; ``toxic_low`` is told both, and only reported. A caller with labels of several kinds of toxicity passes
    them in place of these.
    """
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    return {"unfit": toxic | low, "toxic": toxic, "toxic_low": toxic & low}


#: A document is rejected from this probability of the category ``toxic`` on.
THRESHOLD = 0.5


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Category probabilities of every document and whether it is rejected as toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_categories())
    found = predicted(docs, chain).select("doc_id", "toxicity")
    p = [F.element_at("toxicity", i + 1).alias(c) for i, c in enumerate(chain.categories)]
    return found.select("doc_id", *p).withColumn("is_toxic", F.col("toxic") >= THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows rejected as toxic; the columns stay as they are.

    Null and empty texts are kept (no word speaks against them), repeated rows are judged alike, long texts are
    read whole; with an empty table of labels all rows stay; an empty table stays empty.
    """
    chain = train(docs, labels, label_categories())
    found = predicted(docs, chain)
    return found.where(F.element_at(found.columns[-1], 2) < THRESHOLD).select(*docs.columns)

"""Operator 1: language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import fresh, heavy_keys, sieve, spread_join, written

BUCKETS = 1 << 15
#: The class of rows in which no known language is recognised; its text likelihood is uniform over grams.
UNKNOWN = "und"
#: Letters are folded to lower case, every other ASCII byte is a space; bytes of other scripts stay.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
BLOCK = 1 << 18
#: Bytes of a text model at most (128 KB a class); with more classes a larger ``least`` is asked for.
MODEL_BYTES = 1 << 29


def gram_buckets(text: bytes | None) -> Iterator[np.ndarray]:
    """Hash buckets of all three-byte grams of a text, runs of spaces taken as one, in blocks."""
    data = np.frombuffer(text or b"", np.uint8)
    tail = np.zeros(0, np.uint8)
    for at in range(0, len(data), BLOCK):
        a = np.concatenate((tail, FOLD[data[at : at + BLOCK]]))
        a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
        tail = a[-2:]
        if len(a) > 2:
            b = a.astype(np.uint32)
            yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


class TextModel:
    """Smoothed gram log-probabilities of each language, and of the unknown class at the end."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        smooth = counts + 0.05
        uniform = np.full((1, BUCKETS), 1 / BUCKETS)
        self.languages = [*languages, UNKNOWN]
        self.table = np.log(np.concatenate((smooth / smooth.sum(axis=1, keepdims=True), uniform))).T.astype(np.float32).copy()

    def likelihood(self, text: bytes | None, cap: int) -> np.ndarray:
        """Log-likelihood of the text under each class, scaled down to ``cap`` grams of evidence."""
        total, n = np.zeros(len(self.languages)), 0
        for g in gram_buckets(text):
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total * (min(n, cap) / n) if n else total


def fit(rows: DataFrame, text_col: str, label_col: str, sample: int, least: int = 1) -> TextModel:
    """Gram counts of every declared language over about ``sample`` of its distinct texts, all if it has no more.

    Texts are drawn by their hash, in each language apart. Every declared language with ``least`` or more distinct texts
    (by their approximate number) and with grams is a class; other declared values are evidence like any, but no class. So the
    model (128 KB a class, gathered 64 classes at a time) is bounded by ``MODEL_BYTES`` and not by the number of values.
    """
    labelled = rows.where(F.col(label_col).isNotNull() & (F.col(label_col) != "")).select(F.lower(label_col).alias("label"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("hash"))
    texts = written(labelled.groupBy("label").agg(F.approx_count_distinct("hash").alias("texts")).where(F.col("texts") >= least), "labels")
    if texts.count() * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{texts.count()} declared languages have {least} or more texts: raise ``least``")
    drawn = labelled.join(texts, "label").where(F.pmod("hash", F.greatest("texts", F.lit(1))) < sample).dropDuplicates(["label", "hash"]).select("label", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                own = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                for g in gram_buckets(text):
                    own += np.bincount(g, minlength=BUCKETS)
        for label, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["label", "bucket", "n"])

    counts = drawn.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    chosen = sorted(r[0] for r in counts.select("label").distinct().collect())
    out = np.zeros((len(chosen), BUCKETS), np.float32)
    for at in range(0, len(chosen), 64):
        place = {label: at + i for i, label in enumerate(chosen[at : at + 64])}
        table = counts.where(F.col("label").isin(list(place))).toArrow()  # 64 times the buckets at most
        out[[place[x] for x in table["label"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return TextModel(chosen, out)


def scored(rows: DataFrame, text_col: str, model: TextModel, out_col: str, cap: int) -> DataFrame:
    """``rows`` with ``out_col``: the text's log-likelihood under each class of the model."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # languages times buckets floats, whatever the corpus
    at = rows.columns.index(text_col)
    names = [*rows.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            likes = [own.likelihood(x, cap) for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(likes, pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, rows.withColumn(out_col, F.array(F.lit(0.0))).schema)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def summed(p: DataFrame, by: list[str], of: str = "p") -> DataFrame:
    """(*by, c): the arrays ``of`` summed place by place, a row for each value and class between the shuffles."""
    long = p.select(*by, F.posexplode(of).alias("place", "x")).groupBy(*by, "place").agg(F.sum("x").alias("x"))
    return long.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda r: r["x"]).alias("c"))


def overall(p: DataFrame, n: int) -> list[float]:
    """The sum of each class over all rows."""
    found = {r.place: r.x for r in p.select(F.posexplode("p").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect()}  # a row a class
    return [found.get(i, 0.0) for i in range(n)]


def evidence(p: DataFrame, by: str, n: int, weight: float) -> DataFrame:
    """log P(value of ``by`` | language), smoothed towards the value's overall share."""
    per, whole = summed(p, [by]), overall(p, n)
    total = max(sum(whole), 1e-9)
    languages = F.lit([float(x) for x in whole]) if whole else F.array().cast("array<double>")
    share = F.aggregate("c", F.lit(0.0), lambda s, x: s + x) / F.lit(total)
    return written(per.select(by, F.zip_with("c", languages, lambda c, w: F.log((c + weight * share + 1e-12) / (w + weight + 1e-12))).alias(f"{by}_like")), by)


def host_priors(p: DataFrame, n: int, weight: float) -> DataFrame:
    """log P(language | host): host counts smoothed by the domain's, those by the corpus's."""
    hosts, whole = written(summed(p, ["host", "domain"]), "host_sums"), overall(p, n)
    base = [float((x + 1 / n) / (sum(whole) + 1)) for x in whole]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda c, prior: F.zip_with(c, prior, lambda x, q: (x + weight * q) / (total(c) + weight))
    domains = summed(hosts, ["domain"], "c").select("domain", smooth(F.col("c"), F.lit(base)).alias("q"))
    joined = hosts.join(domains, "domain")
    return written(joined.select("host", "domain", F.transform(smooth(F.col("c"), F.col("q")), lambda x: F.log(x)).alias("host_prior")), "hosts")


def identify(rows: DataFrame, text_col: str, declared: Column, address: Column | None, host: Column, sample: int = 20000, cap: int = 200, weight: float = 20.0, narrow: bool = False, least: int = 5) -> DataFrame:
    """``rows`` with ``language``, ``confidence`` (its posterior) and ``declared_as``.

    Evidence: (1) byte-trigram likelihoods of the text, fitted on about ``sample`` distinct texts of each declared language with
    ``least`` or more (others are values, not classes), and counted as ``cap`` grams at most; (2) the declared markup language and (3) the address suffix, as likelihoods
    P(value | language) from sums of text posteriors grouped by value over all rows; (4) the host's prior,
    its grouped sums smoothed with ``weight`` rows of the domain's prior, and that with the corpus's. The class
    ``und`` has a uniform text likelihood: it wins where no language explains the grams, and for texts without
    any if no other evidence speaks. The tables of (2) to (4) are joined by value; Spark broadcasts them where
    their written size allows and else sorts and splits skewed values.

    ``address`` is a host name of which the last label is the suffix (None: no such evidence). ``narrow``
    drops the text after the first pass. Texts are read whole, in blocks; of classes of equal posterior the first
    by name wins. Null or empty texts, declarations, addresses
    and hosts are values like others; repeated rows are scored alike; an empty table gives no rows; columns
    named like those added are kept and the added ones get an underscore.
    """
    from_rows = rows.columns
    d, s, h, m, like = (fresh(rows, x) for x in ("declared_x", "suffix_x", "host_x", "domain_x", "like_x"))
    name = F.lower(F.coalesce(host, F.lit("")))
    rows = rows.withColumns({
        d: F.lower(F.coalesce(declared, F.lit(""))),
        s: F.lower(F.regexp_extract(F.coalesce(address, F.lit("")) if address is not None else F.lit(""), r"\.([^.]+)$", 1)),
        h: name, m: F.regexp_extract(name, r"([^.]+\.[^.]+)$|^([^.]*)$", 0),
    })
    model = fit(rows, text_col, d, sample, least)
    n = len(model.languages)
    found = scored(rows, text_col, model, like, cap)
    found = written(found.drop(text_col) if narrow else found, "likelihoods")  # each text is scored once
    p = found.select(F.col(d).alias("declared"), F.col(s).alias("suffix"), F.col(h).alias("host"), F.col(m).alias("domain"), softmax(F.col(like)).alias("p"))
    hosts = host_priors(p, n, weight).withColumnsRenamed({"host": "host_k", "domain": "domain_k"})
    by_declared = evidence(p, "declared", n, weight)
    by_suffix = evidence(p, "suffix", n, weight)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = (
        found.join(hosts, (F.col(h) == F.col("host_k")) & (F.col(m) == F.col("domain_k")), "left")
        .join(by_declared, F.col(d) == F.col("declared"), "left")
        .join(by_suffix, F.col(s) == F.col("suffix"), "left")
    )
    score = add(add(F.col(like), F.col("host_prior")), add(F.col("declared_like"), F.col("suffix_like")))
    post = softmax(score)
    kept = [c for c in from_rows if not (narrow and c == text_col)]
    language, confidence, stated = (fresh(rows, x) for x in ("language", "confidence", "declared_as"))
    classes = F.array(*[F.lit(x) for x in model.languages])
    return joined.select(
        *kept, F.element_at(classes, F.array_position(post, F.array_max(post)).cast("int")).alias(language), F.array_max(post).alias(confidence), F.col(d).alias(stated)
    )


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)"
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;"
DECLARED = r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document and of every page; rows of class ``und`` are rejected (kept false)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("markup"), F.lit(None).cast("string").alias("address"), F.col("source").alias("site")
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.regexp_replace("html", MARKUP, " ").alias("text"),
        F.regexp_extract("html", DECLARED, 1).alias("markup"), F.regexp_extract("url", HOST, 1).alias("address"), F.regexp_extract("url", HOST, 1).alias("site"),
    )
    found = identify(docs.unionByName(pages), "text", F.col("markup"), F.col("address"), F.col("site"), narrow=True)
    return found.select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"), F.col("declared_as").alias("declared"), (F.col("language") != UNKNOWN).alias("kept"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in which no language is recognised; the columns stay as they are.

    Rows of null, empty or unknown text stay where their declaration or source speaks for a language; repeated
    rows are judged alike; an empty table stays empty.
    """
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    same = F.md5(F.concat_ws("\n", F.length("lang").cast("string"), value("lang"), value("source"), F.md5(value("text").cast("binary"))).cast("binary"))
    key = fresh(docs, "key_x")
    # rows equal in these three are judged alike, so the decision goes back by their hash and texts are scored once
    found = identify(docs.select(same.alias("key"), "text", "lang", "source"), "text", F.col("lang"), None, F.col("source"), narrow=True)
    rejected = written(found.where(F.col("language") == UNKNOWN).groupBy("key").agg(F.count("*").alias("n")), "rejected")
    heavy = heavy_keys(rejected, "key", "n")
    keyed, touched = docs.withColumn(key, same), sieve(rejected, "key")
    rest = spread_join(keyed.where(touched(key)), rejected.select(F.col("key").alias(key)), key, "left_anti", heavy)
    return keyed.where(~touched(key)).unionByName(rest).select(*docs.columns)

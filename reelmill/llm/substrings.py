"""Operator 7: removal of repeated word passages by suffix automata of reference shards."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import batch, forget, fresh, heavy_keys, mix, release, sieve, signed, spread_join, tables_so_far, word_hashes, words_of, written

#: Words of the gram whose least hash anchors a window.
GRAM = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct segments that one automaton of an anchor holds at most; windows of anchors with more are counted by slices.
REFERENCE = 512
#: Bytes of all distinct segments up to which their automata are broadcast, and bytes of one such shard.
BROADCAST, SHARD = 1 << 20, 1 << 18

SEGMENTS = pa.schema([("uid", pa.binary()), ("anchor", pa.int64()), ("start", pa.int32()), ("seg", pa.binary()), ("body", pa.binary()), ("times", pa.int64())])
SPANS = pa.schema([("seg", pa.binary()), ("spans", pa.list_(pa.int32()))])
WINDOWS = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("window", pa.binary()), ("times", pa.int64())])


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each run of windows that share their anchor.

    The anchor of a window is its gram of least hash, the leftmost on ties: it depends on the window's words
    alone, so every occurrence of a window, wherever it is, has the same anchor.
    """
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    gram = min(GRAM, window)
    h = word_hashes(words)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        g = g * BASE + h[i : i + len(g)]
    g = mix(g)
    reach = window - gram + 1  # grams in a window
    least = np.arange(len(g))
    span = 1
    while span < reach:  # positions of the least of 2, 4, ... grams; the last step overlaps
        step = min(span, reach - span)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(g[b] < g[a], b, a)
        span += step
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return g[least[first]], first, np.append(first[1:], n) - 1


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the number of times that each state's words occur."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, words: list[bytes], times: int) -> None:
        """Add a sequence that occurs so many times; sequences do not run into each other."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = nexts[last].get(w, -1)
            if q >= 0 and length[q] == length[last] + 1:
                last = q
                count[q] += times
                continue
            if q >= 0:  # the state is there, but also stands for longer words: split it
                last = self.split(last, q, w)
                count[last] += times
                continue
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(times)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self.split(p, q, w)
            last = new

    def split(self, p: int, q: int, w: bytes) -> int:
        copy = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def finish(self) -> None:
        """Sum the counts towards shorter suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def covered(self, words: list[bytes], window: int, least: int) -> list[int]:
        """Ends-exclusive [start, end, ...] of the maximal spans of ``words`` in windows that occur ``least`` times.

        Matching statistics: for each word the longest run ending there that the automaton holds often enough.
        """
        nexts, link, length, count = self.next, self.link, self.length, self.count
        state = have = 0
        spans: list[int] = []
        for i, w in enumerate(words):
            while state and (w not in nexts[state] or count[nexts[state][w]] < least):
                state = link[state]
                have = length[state]
            to = nexts[state].get(w, -1)
            if to >= 0 and count[to] >= least:
                state, have = to, have + 1
                # the run may be shorter than the state's words: step to the suffix that holds it
                while length[link[state]] >= have:
                    state = link[state]
            else:
                state = have = 0
            if have >= window:
                start = i + 1 - have
                if spans and start <= spans[-1]:
                    spans[-1] = i + 1
                    spans[-2] = min(spans[-2], start)
                else:
                    spans += [start, i + 1]
        return spans


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return batch(schema, **{n: list(c) for n, c in zip(schema.names, zip(*rows))})


def segment_rows(texts: DataFrame, window: int, bodies: bool) -> DataFrame:
    """(uid, anchor, start, seg, body, times) of each row of (uid, text, wanted, times): the words of the windows of each wanted anchor.

    ``seg`` is the MD5 of the body; without ``bodies`` the body is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for uid, text, wanted, times in zip(*b.columns):
                uid, own, times, words = uid.as_py(), set(wanted.as_py()), times.as_py(), words_of(text.as_py())
                h, first, last = anchors(words, window)
                for a, s, e in zip(signed(h).tolist(), first.tolist(), last.tolist()):
                    if a in own:
                        body = b" ".join(words[s : e + window])
                        out.append((uid, a, s, hashlib.md5(body).digest(), body if bodies else None, times))
                if len(out) > 20000:
                    yield rows_of(SEGMENTS, out)
                    out = []
            if out:
                yield rows_of(SEGMENTS, out)

    return texts.select("uid", "text", "wanted", "times").mapInArrow(run, "uid binary, anchor long, start int, seg binary, body binary, times long")


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchor_rows(texts: DataFrame, keep: list[str], window: int) -> DataFrame:
    """``keep``, uid, n_words, whole_sha256 (of all words) and anchors (array of long) of each row of (*keep, uid, text)."""
    schema = texts.select(*keep, "uid").withColumns({"n_words": F.lit(0).cast("long"), "whole_sha256": F.lit(""), "anchors": F.array(F.lit(0).cast("long"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, whole, found = [], [], []
            for text in b.column(len(keep) + 1):  # one text at a time: its words take several times its size
                words = words_of(text.as_py())
                count.append(len(words))
                whole.append(digest(words))
                found.append(signed(anchors(words, window)[0]))
            columns = [*b.columns[:-1], pa.array(count, pa.int64()), pa.array(whole, pa.string()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.select(*keep, "uid", "text").mapInArrow(run, schema)


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[bytes, int, list[bytes]]], set[bytes]]]:
    """(anchor, part, [(seg, times, its windows' MD5s)], windows named) for each slice of sorted rows (anchor, part, window, seg, body, times, size).

    A row has either a window or a segment.
    """
    key, members, named = None, [], set()
    for b in batches:
        for anchor, part, window, seg, body, times, size in zip(*(c.to_pylist() for c in b.columns)):
            if (anchor, part) != key:
                if members:
                    yield *key, members, named
                key, members, named = (anchor, part), [], set()
            if seg is None:
                named.add(window)
            else:
                words = body.split(b" ")
                members.append((seg, times, [hashlib.md5(b" ".join(words[i : i + size])).digest() for i in range(len(words) - size + 1)]))
    if members:
        yield *key, members, named


def windows_in(members: list[tuple[bytes, int, list[bytes]]]) -> Counter:
    """How often each window occurs in a slice."""
    found: Counter = Counter()
    for _, times, windows in members:
        for w in windows:
            found[w] += times
    return found


def repeated_windows(segments: DataFrame, window: int, reference: int) -> DataFrame:
    """(seg, spans) for segments (anchor, seg, body, times, n) of anchors with ``n`` > ``reference`` distinct segments.

    An anchor's segments are dealt in slices of about ``reference``. A slice gives each of its distinct windows once,
    by the MD5 of the words, with its times; it is told which of those that it holds once are in other slices too.
    Rows grow with the segments however many contexts an anchor has, and near copies in a slice share theirs.
    """
    part = F.pmod(F.hash("seg"), F.ceil(F.col("n") / reference)).cast("int").alias("part")
    slices = written(segments.select("anchor", part, "seg", "body", "times"), "slices")
    told = slices.select("anchor", "part", F.lit(None).cast("binary").alias("window"), "seg", "body", "times", F.lit(window).alias("size"))
    dealt = lambda df: df.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.col("seg").isNotNull())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, part, members, _ in slices_of(batches):
            yield rows_of(WINDOWS, [(anchor, part, w, times) for w, times in windows_in(members).items()])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, members, named in slices_of(batches):
            named |= {w for w, times in windows_in(members).items() if times > 1}
            out = [(seg, [x for i, w in enumerate(windows) if w in named for x in (i, i + window)]) for seg, _, windows in members]
            if out := [(seg, spans) for seg, spans in out if spans]:
                yield rows_of(SPANS, out)

    rows = written(dealt(told).mapInArrow(tell, "anchor long, part int, window binary, times long"), "windows")
    counts = written(rows.groupBy("window").agg(F.sum("times").alias("all"), F.count("*").alias("n")), "counts")
    again = spread_join(rows.where("times = 1"), counts.where("all > 1").select("window"), "window", "left_semi", heavy_keys(counts, "window", "n"))
    return dealt(told.unionByName(again.select("anchor", "part", "window"), allowMissingColumns=True)).mapInArrow(settle, "seg binary, spans array<int>")


def matched(segments: DataFrame, window: int, reference: int) -> DataFrame:
    """(seg, spans) for the distinct segments (anchor, seg, body, times) that hold a repeated window.

    The segments of an anchor are a reference shard: its suffix automaton is built from them and they are
    streamed through it; windows need to occur twice. Anchors with over ``reference`` distinct segments go to
    ``repeated_windows``, so no group is larger than that and none is multiplied.
    """
    per = written(segments.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("all")), "contexts")
    rows = spread_join(segments, per.where("all > 1").select("anchor", "n"), "anchor", "inner", heavy_keys(per, "anchor", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        out: list[tuple] = []

        def settle() -> None:
            if len(members) == 1:  # one sequence that occurs often: the automaton is a chain
                out.append((members[0][0], [0, len(members[0][1])]))
            elif members:
                tree = automaton([(words, times) for _, words, times in members])
                for seg, words, _ in members:
                    if spans := tree.covered(words, window, 2):
                        out.append((seg, spans))

        for b in batches:
            for anchor, seg, body, times in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != key:
                    settle()
                    key, members = anchor, []
                members.append((seg, body.split(b" "), times))
            if out:
                yield rows_of(SPANS, out)
                out = []
        settle()
        if out:
            yield rows_of(SPANS, out)

    dealt = rows.where(F.col("n") <= reference).select("anchor", "seg", "body", "times").repartition("anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(run, "seg binary, spans array<int>")
    if per.where(F.col("n") > reference).isEmpty():
        return found
    return found.unionByName(repeated_windows(rows.where(F.col("n") > reference), window, reference))


def automaton(sequences: list[tuple[list[bytes], int]]) -> SuffixAutomaton:
    tree = SuffixAutomaton()
    for words, times in sequences:
        tree.add(words, times)
    tree.finish()
    return tree


def streamed(texts: DataFrame, shards: list[list[tuple[bytes, int]]], window: int) -> DataFrame:
    """(uid, spans) of each row of (uid, text) that repeats something: every text runs through every broadcast shard's automaton.

    ``shards`` are (body, times) of segments, all segments of an anchor in one shard, so a window's occurrences
    are counted in one place.
    """
    sent = texts.sparkSession.sparkContext.broadcast(shards)  # at most BROADCAST bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [automaton([(body.split(b" "), times) for body, times in shard]) for shard in sent.value]
        for b in batches:
            out = []
            for uid, text in zip(*b.columns):
                words = words_of(text.as_py())
                spans = [x for tree in trees for x in tree.covered(words, window, 2)]
                if spans:
                    out.append((uid.as_py(), spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], names=["uid", "spans"])

    return texts.select("uid", "text").mapInArrow(run, "uid binary, spans array<int>")


def repeats(docs: DataFrame, text_col: str, keep: list[str], window: int, reference: int = REFERENCE, broadcast: int = BROADCAST) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """What removal needs: all rows (*keep, uid, n_words, whole_sha256), texts with candidates (uid, text), spans (uid, spans), heavy uids.

    ``uid`` is the MD5 of the text: copies are one text with its number, and share their spans. Spans are flat
    pairs of word numbers.

    1. Each text gives the anchors of its windows; an anchor that occurs once cannot hold a repeated window.
    2. Texts with repeated anchors give the segments around them; equal segments are counted before the shuffle.
    3. The distinct segments are the reference. Where all of them are small (``broadcast`` bytes), their automata
       are broadcast in shards and the texts streamed through; else each anchor's segments meet in its automaton.
    """
    texts = docs.select(*keep, F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("uid"), F.col(text_col).alias("text"))
    rows = written(anchor_rows(texts, keep, window), "anchors")
    distinct = written(rows.where("uid is not null").groupBy("uid").agg(F.first("anchors").alias("anchors"), F.count("*").alias("times")), "texts")
    heavy = heavy_keys(distinct, "uid", "times")
    single = distinct.select("uid", "times", F.explode("anchors").alias("anchor"))
    counts = written(single.groupBy("anchor").agg(F.sum("times").alias("all"), F.count("*").alias("n")), "counts")
    again = spread_join(single, counts.where("all > 1").select("anchor"), "anchor", "left_semi", heavy_keys(counts, "anchor", "n"))
    wanted = written(again.groupBy("uid").agg(F.collect_set("anchor").alias("wanted"), F.first("times").alias("times")), "wanted")
    one = texts.select("uid", "text").dropDuplicates(["uid"])  # copies meet before the shuffle, and the join needs no other
    candidates = written(one.join(wanted, "uid"), "candidates")
    release(docs.sparkSession)
    counted = segment_rows(candidates, window, bodies=True).groupBy("anchor", "seg").agg(F.first("body").alias("body"), F.sum("times").alias("times"))
    counted = written(counted, "segments")
    size = counted.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size <= broadcast:
        shards: dict[int, list] = {}
        for anchor, body, times in counted.select("anchor", "body", "times").collect():  # at most ``broadcast`` bytes
            shards.setdefault(anchor % (size // SHARD + 1), []).append((bytes(body), times))
        spans = written(streamed(candidates, list(shards.values()), window), "spans")
    else:
        found = written(matched(counted, window, reference), "matches")
        release(docs.sparkSession)
        places = written(segment_rows(candidates, window, bodies=False).select("uid", "seg", "start"), "places")
        per = places.groupBy("seg").agg(F.count("*").alias("n"))
        placed = spread_join(places, found, "seg", "inner", heavy_keys(per, "seg", "n"))
        moved = placed.select("uid", F.transform("spans", lambda s: s + F.col("start")).alias("spans"))
        spans = written(moved.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    return rows.drop("anchors"), candidates.select("uid", "text"), spans, heavy


def removed_flags(n: int, spans: list[int]) -> list[int]:
    """For each of ``n`` words how many spans cover it."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, spans[::2], 1)
    np.add.at(cover, spans[1::2], -1)
    return np.cumsum(cover)[:n].tolist()


WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode()
    found = list(WORD.finditer(data))
    cover = removed_flags(len(found), spans)
    start = found[0].start() if found else len(data)
    return (data[:start] + b"".join(m[0] for m, c in zip(found, cover) if not c)).decode()


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, reference: int = REFERENCE, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with each text cleared of the words in windows of ``window`` words that also occur elsewhere.

    Windows are judged on the input, all occurrences go, in the same document too; what stays keeps its white
    space. Null texts stay null, texts shorter than a window stay as they are, repeated rows count as
    occurrences of each other, an empty table stays empty, other columns are not touched. Words are whatever
    ASCII white space separates. However many contexts a passage has, rows grow with the texts that hold it:
    an automaton has at most ``reference`` distinct segments, and what is more goes by window. A large group
    of copies is one text with a number. Only texts that may hold a repeat (``common.sieve``) are shuffled for the
    result and go to Python; all others pass where they are.
    """
    since = tables_so_far()
    _, _, spans, heavy = repeats(docs, text_col, [], window, reference, broadcast)
    forget(docs.sparkSession, since, "spans")
    uid, found = fresh(docs, "uid_x"), fresh(docs, "spans_x")
    spans = spans.withColumnsRenamed({"uid": uid, "spans": found})
    touched = sieve(spans, uid)
    named = docs.withColumn(uid, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    both = spread_join(named.where(touched(uid)), spans, uid, "left", heavy).select(*docs.columns, found)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return named.where(~touched(uid)).select(*docs.columns).unionByName(both.mapInArrow(run, docs.schema))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones for every document, windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    since = tables_so_far()
    rows, texts, spans, heavy = repeats(docs, "text", ["doc_id"], 35)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for text, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(without(text, s))
                gone.append(len(words_of(text)) - len(words))
                kept.append(digest(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["uid", "n_removed", "sha"])

    changed = texts.join(spans, "uid").mapInArrow(run, "uid binary, n_removed long, sha string")
    changed = written(changed, "changed")
    forget(spark, since, "anchors", "changed")
    return spread_join(rows, changed, "uid", "left", heavy).select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("sha", "whole_sha256").alias("kept_sha256"))


OP7_SQL = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT rid, unnest(range(1, len(w) - 33)) AS pos FROM words WHERE len(w) >= 35
), windows AS (
  SELECT s.rid, s.pos, md5(array_to_string(w[s.pos : s.pos + 34], ' ')) AS h FROM starts s JOIN words USING (rid)
), repeated AS (
  SELECT rid, pos FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT rid, list(DISTINCT p) AS g FROM (SELECT rid, unnest(range(pos, pos + 35)) AS p FROM repeated) GROUP BY rid
), kept AS (
  SELECT doc_id, w, coalesce(g, []) AS g FROM words LEFT JOIN gone USING (rid)
)
SELECT doc_id, len(w)::bigint AS n_words, len(g)::bigint AS n_removed,
  sha256(array_to_string(list_select(w, list_sort(list_where_gap)), ' ')) AS kept_sha256
FROM (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)) AS list_where_gap FROM kept)
"""

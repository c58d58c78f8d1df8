"""Operator 11: fill-in-middle transformation; cuts between lines are found by overlapping chunks and prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import fresh

#: Bytes of a chunk. Each also looks at the byte before it, so a line that ends with one chunk begins the next.
CHUNK = 4096
SENTINELS = ("<P>", "<S>", "<M>")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends); nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks_of(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of each text begin, and the number of the first chunk of each text (and one past the last)."""
    per = -(-np.diff(at) // size)
    first = np.concatenate(([0], np.cumsum(per)))
    return np.repeat(at[:-1], per) + size * (np.arange(first[-1]) - np.repeat(first[:-1], per)), first


def begins(data: np.ndarray, start: int, end: int, texts: np.ndarray) -> np.ndarray:
    """For each byte from ``start`` to ``end`` whether a line begins there: after a line feed or at a text's begin.

    The predicate looks at a byte and the one before, which may be the last of another chunk.
    """
    found = np.zeros(end - start, bool)
    lead = 1 if start == 0 else 0
    found[lead:] = data[start - 1 + lead : end - 1] == 10
    inside = texts[np.searchsorted(texts, start) : np.searchsorted(texts, end)]
    found[inside - start] = True
    return found


class Lines:
    """The lines of a batch of texts: their numbers by chunk, summed up, and the place of any line by its number."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: int = CHUNK):
        self.data, self.at, self.begin = data, at, np.unique(at[:-1][np.diff(at) > 0])
        self.start, self.first = chunks_of(at, size)
        self.end = np.append(self.start[1:], at[-1]) if len(self.start) else self.start
        marks = begins(data, int(at[0]), int(at[-1]), self.begin)
        counts = np.add.reduceat(marks, self.start - at[0], dtype=np.int64) if len(self.start) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))  # lines that begin before each chunk
        self.n = np.diff(self.before[self.first])

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """The byte at which line ``ranks[i]`` of text i begins, or the text's end for one past the last.

        The prefix sums name the chunk that owns a rank; only these chunks are looked at again.
        """
        out = self.at[1:].copy()
        cut = np.flatnonzero(ranks < self.n)
        wanted = self.before[self.first[cut]] + ranks[cut] + 1
        owner = np.searchsorted(self.before, wanted, "left") - 1
        for i, w, c in zip(cut.tolist(), wanted.tolist(), owner.tolist()):
            s, e = int(self.start[c]), int(self.end[c])
            out[i] = s + np.flatnonzero(begins(self.data, s, e, self.begin))[w - int(self.before[c]) - 1]
        return out


def draws(seed: int, row_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits from the SHA-256 of seed and id (a null id: of the seed alone)."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, suffix_first: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars and output in place of the text.

    A text is cut at two line numbers drawn by its id into prefix, middle and suffix. Form ``psm`` writes prefix,
    suffix, middle, each after its sentinel; ``spm`` (``suffix_first`` of a hundred) writes suffix, prefix, middle;
    ``plain`` leaves the text: where it is empty, holds a sentinel, or isn't among the ``rate`` of a hundred.

    Lines are counted by chunks of all texts of a batch at once, so a very long text is many chunks and short ones
    are handled together; the sums route both cuts to their chunks. Texts are read once, where they lie, and nothing
    is shuffled. Null texts count as empty; a null id draws by the seed alone; repeated rows give equal outputs;
    a text without a line feed is one line; an empty table stays empty. Other columns are kept, and underscores are
    added to a new column's name that they have.
    """
    keep = [c for c in docs.columns if c != text_col]
    types = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    held = docs.select(*keep)
    names: list[str] = []
    for c in types:
        names.append(fresh(held, c))
        held = held.withColumn(names[-1], F.lit(None).cast(types[c]))
    p, s, m = (x.encode() for x in sentinels)
    own = docs.select(*keep, F.col(id_col).cast("long").alias(fresh(held, "id")), F.col(text_col).cast("string").alias(fresh(held, "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(b.num_columns - 1))
            drawn = np.array([draws(seed, i) for i in b.column(b.num_columns - 2).to_pylist()], np.int64).reshape(-1, 4)
            lines = Lines(data, at, chunk)
            cuts = np.sort(drawn[:, :2] % (lines.n + 1)[:, None], axis=1)
            low, high = lines.places(cuts[:, 0]), lines.places(cuts[:, 1])
            whole, form, prefix, middle, output = data.tobytes(), [], [], [], []
            for i, (start, end, a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), low.tolist(), high.tolist())):
                text = whole[start:end]
                if not text or p in text or s in text or m in text or drawn[i, 2] % 100 >= rate:
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                one, two, three = text[: a - start], text[a - start : z - start], text[z - start :]
                first = drawn[i, 3] % 100 < suffix_first
                form.append("spm" if first else "psm")
                prefix.append(len(one.decode(errors="replace")))
                middle.append(len(two.decode(errors="replace")))
                output.append(b"".join((s, three, p, one, m, two) if first else (p, one, s, three, m, two)))
            made = pa.array(lines.n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], names=[*keep, *names])

    return own.mapInArrow(run, held.schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` had: a cut text holds no sentinel, so the first of each in the output is its own."""
    part = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels), 4)
    piece = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, the characters of its parts, and digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u)::bigint AS n, ('0x' || h[1:8])::bigint % (len(u) + 1) AS a, ('0x' || h[9:16])::bigint % (len(u) + 1) AS b, ('0x' || h[17:24])::bigint % 100 AS c, ('0x' || h[25:32])::bigint % 100 AS s FROM d
), cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""

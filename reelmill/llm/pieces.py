"""Operator 10: SentencePiece encoding by batched Viterbi in numpy, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character scores so much less than the least piece (fixed value of the format's library).
UNKNOWN_PENALTY = 10.0
#: Stands for a space sign of the text itself; no valid text holds it.
LITERAL = "\ud800"
DONE = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task keeps with their ids before it forgets them; words in one batch of the lattice; word length beyond which it is walked alone.
KEPT, TOGETHER, LONG = 400_000, 8_192, 64
#: Rows that a task encodes before it hands them on.
SLICE = 256


class Vocabulary:
    """Pieces, scores and byte pieces of a model, with the sorted hash keys of each piece length.

    Segmentation is Viterbi's: of all ways to cut a word into pieces the one with the greatest sum of scores,
    ties to the longer last piece. Pieces that could cross the start of a word make a model unfit.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.size = len(pieces)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        if bad := [pieces[i] for i in normal if re.search(f"[^{SPACE}]{SPACE}", pieces[i])]:
            raise ValueError(f"pieces cross the start of a word: {bad[:3]}")
        self.unknown = min(scores[i] for i in normal) - UNKNOWN_PENALTY
        self.byte_ids = [0] * 256
        self.text = [b""] * len(pieces)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif k == "normal":
                self.text[i] = p.replace(SPACE, " ").encode()
        self.widths = np.array([len(t) for t in self.text])
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        letters = sorted({c for i in normal for c in pieces[i]} - {SPACE})
        known = "".join(map(re.escape, letters))
        # a word: spaces and what follows them; a character in no piece stands alone
        self.words = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]")
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.there = np.zeros(1 << 20, bool)
        for n in sorted({len(pieces[i]) for i in normal}):
            own = [i for i in normal if len(pieces[i]) == n]
            h = np.zeros(len(own), np.uint64)
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64)
            for j in range(n):
                h = h * BASE + codes[:, j] + np.uint64(1)
            order = np.argsort(h)
            self.keys[n] = h[order], np.array(own)[order], np.array([scores[i] for i in own])[order]
            self.there[h >> np.uint64(44)] = True

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.IsByte(i) else "other" if m.IsControl(i) or m.IsUnknown(i) or m.IsUnused(i) else "normal"
        ids = range(m.GetPieceSize())
        return cls([m.IdToPiece(i) for i in ids], [m.GetScore(i) for i in ids], [kind(i) for i in ids])

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each end and piece length the piece's score (or -inf) and id, over words of equal length."""
        n, length = codes.shape
        longest = min(length, max(self.keys))
        prefix = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j] + np.uint64(1)
        score = np.full((longest + 1, length + 1, n), -np.inf)
        ids = np.full((longest + 1, length + 1, n), -1, np.int32)
        power = np.uint64(1)
        for w in range(1, longest + 1):
            power = np.uint64(int(power) * int(BASE) & 0xFFFFFFFFFFFFFFFF)
            if w not in self.keys:
                continue
            keys, own, scores = self.keys[w]
            h = (prefix[:, w:] - prefix[:, :-w] * power).T
            end, word = np.nonzero(self.there[h >> np.uint64(44)])
            probe = h[end, word]
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            hit = keys[at] == probe
            end, word, at = end[hit], word[hit], at[hit]
            score[w, end + w, word], ids[w, end + w, word] = scores[at], own[at]
        alone = ids[1] < 0
        score[1][alone] = self.unknown
        return score, ids

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as 32-bit integers; words of one length advance together."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, TOGETHER * 8 // max(8, length)) if length <= LONG else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length).astype(np.uint64)
                ids, counts = self.best(codes)
                if ids.min() < 0:  # an unknown character becomes its byte pieces
                    rows = np.repeat(np.arange(len(part)), counts).tolist()
                    spelt = [[] for _ in part]
                    for row, i in zip(rows, ids.tolist()):
                        spelt[row] += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).replace(LITERAL, SPACE).encode()]
                    out.update((w, np.array(x, np.int32).tobytes()) for w, x in zip(part, spelt))
                else:
                    flat, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
                    out.update((w, flat[a:b]) for w, a, b in zip(part, [0, *ends], ends))
        return out

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of equal length: the ids of all words and each word's number; an unknown character c is -1 - c."""
        n, length = codes.shape
        block = 1 << 12
        if length > block:  # one very long word: its lattice is made in blocks that overlap by the longest piece
            ids = np.array(self.walked(codes[0], block))
            return ids, np.array([len(ids)])
        score, ids = self.lattice(codes)
        total = np.zeros((length + 1, n))
        width = np.zeros((length + 1, n), np.int64)
        rows = np.arange(n)
        for end in range(1, length + 1):
            most = min(end, len(score) - 1)
            sums = total[end - most : end] + score[most:0:-1, end]  # longer pieces first: ties stay with them
            first = sums.argmax(axis=0)
            total[end] = sums[first, rows]
            width[end] = most - first
        at, steps = np.full(n, length), []
        while at.any():
            w = width[at, rows]  # 0 at the start of a word
            piece = ids[w, at, rows].astype(np.int64)
            missing = (piece < 0) & (at > 0)
            piece[missing] = -1 - codes[rows[missing], at[missing] - 1].astype(np.int64)
            piece[at == 0] = DONE
            steps.append(piece)
            at = at - w
        found = np.array(steps[::-1]).T
        real = found != DONE
        return found[real], real.sum(axis=1)

    def walked(self, codes: np.ndarray, block: int) -> list[int]:
        length, longest = len(codes), max(self.keys)
        total, width, piece = np.full(length + 1, -np.inf), [0] * (length + 1), [0] * (length + 1)
        total[0] = 0
        for at in range(0, length, block):
            first = max(0, at - longest)
            score, ids = self.lattice(codes[None, first : at + block])
            for end in range(at + 1, min(length, at + block) + 1):
                for w in range(min(end, longest, len(score) - 1), 0, -1):
                    s = score[w, end - first, 0] if end - first >= w else -np.inf
                    if total[end - w] + s > total[end]:
                        total[end], width[end], piece[end] = total[end - w] + s, w, int(ids[w, end - first, 0])
        out, end = [], length
        while end:
            out.append(piece[end] if piece[end] >= 0 else -1 - int(codes[end - 1]))
            end -= width[end]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """The words of a text: a space goes before it and stands as the space sign.

        A space sign that the text itself holds is no space: it becomes a character in no piece.
        """
        return self.words.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))

    def decode(self, ids) -> str:
        """The text of a sequence of ids; byte pieces join to UTF-8, the first space goes. Nulls are nothing, ids of no piece U+FFFD."""
        if not isinstance(ids, np.ndarray):
            ids = [i for i in ids if i is not None]
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.widths))
        if not known.all():
            piece = lambda i: self.bytes[self.starts[i] : self.starts[i] + self.widths[i]].tobytes() if 0 <= i < len(self.widths) else "\ufffd".encode()
            text = b"".join(map(piece, ids.tolist())).decode("utf-8", "replace")
            return text[1:] if text[:1] == " " else text
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + widths, widths)
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes texts one batch at a time, with the words seen lately."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Ids of each text, in order; None for None. About a million characters are looked up together."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and size < 1_000_000:
                size += len(texts[upto] or "")
                upto += 1
            split = [None if t is None else self.vocabulary.split(t) if t else [] for t in texts[at:upto]]
            new = set(chain.from_iterable(s for s in split if s)).difference(self.known)
            if len(self.known) > KEPT:
                self.known.clear()
                new = set(chain.from_iterable(s for s in split if s))
            self.known.update(self.vocabulary.segment(list(new)))
            for s in split:
                yield None if s is None else np.frombuffer(b"".join(map(self.known.__getitem__, s)), np.int32)
            at = upto


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL, back_col: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``: the piece ids of the whole text (array of int); with ``back_col``: the text decoded from them.

    For models without normalisation of their own (identity, space put before the text, byte fallback). Null
    texts have null ids, the empty text none; characters in no piece, and the space sign itself, are spelt in
    byte pieces, so decoding gives the text back. Repeated words of a task are segmented once; memory is bounded
    by a few hundred rows and the words kept. Repeated rows get equal ids; an empty table gives none; an
    existing column of that name stays and the new one gets an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = T.StructType([*docs.schema, T.StructField(fresh(docs, out_col), T.ArrayType(T.IntegerType()))])
    if back_col:
        schema = schema.add(fresh(docs, back_col), T.StringType())
    at, names = docs.columns.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            ids = list(encoder.encode(b.column(at).to_pylist()))
            columns = [*b.columns, pa.array(ids, pa.list_(pa.int32()))]
            if back_col:
                columns.append(pa.array([None if i is None else sent.value.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with ``out_col``: the text of the ids; null for null.

    Null elements count as nothing, ids that the model doesn't have (negative ones too) give U+FFFD each, no ids the
    empty text. An existing column of that name stays and the new one gets an underscore; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    out_col = fresh(docs, out_col)
    at, names = docs.columns.index(ids_col), [*docs.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if i is None else sent.value.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out_col, T.StringType())]))


def op10_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, a digest of its ids, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, back_col="decoded")
    packed = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"), F.md5(packed).alias("ids_md5"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )

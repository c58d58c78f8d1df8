"""Fill-in-middle against a slow version, with lines and chunks of all sizes."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.llm import infill


def slow(doc_id, text, rate=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(8)
    piece = lambda: rng.choice(["\n", "\n\n", "a", "é", "😀", "word ", "\r\n", "<", "<P", "S>"])
    texts = ["".join(piece() for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*texts, None, "", "\n", "\n" * 9000, "x" * 9000, "a <P> b\nc\nd", "<S>", "<M>\n", "é\n" * 5000, "end<", "a\nb<S"]


@pytest.mark.parametrize("chunk", [1, 3, 64, 4096])
def test_outputs_match_a_slow_version(spark, chunk):
    texts = odd_texts() if chunk > 1 else odd_texts()[:302]
    rows = [(i, t, "e") for i, t in enumerate(texts)] + [(None, "a\nb\nc", None), (5, texts[5], "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    out = infill.fill_in_middle(df, rate=80, suffix_first=30, chunk=chunk).withColumn("back", infill.restored(F.col("output"), F.col("form_")))
    got = [(r.doc_id, r.form, r.n, r.form_, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((i, e, *slow(i, t, 80, 30), t or "") for i, t, e in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_only_owning_chunks_are_looked_at_again(monkeypatch):
    data, at = infill.flat(pa.array(["a\n" * 5000, "", "b" * 3000, "c\nd"]))
    lines = infill.Lines(data, at, 100)
    assert lines.n.tolist() == [5000, 0, 1, 2] and len(lines.start) == 100 + 30 + 1
    seen = []
    look = infill.begins
    monkeypatch.setattr(infill, "begins", lambda d, s, e, t: seen.append(e - s) or look(d, s, e, t))
    assert lines.places(np.array([4999, 0, 0, 2])).tolist() == [9998, 10000, 10000, 13003]
    assert len(seen) == 2 and max(seen) <= 100


def test_query_matches_its_sql_and_a_slow_version(spark, docs, folder, empty):
    got = infill.op11_infill(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(infill.OP11_SQL)
    names = [c[0] for c in found.description]
    rows = got.select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, found.fetchall()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(r.doc_id, *(s := slow(r.doc_id, r.text))[:4], sha(s[4]), sha(r.text or "")) for r in docs.collect()]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, expected))
    assert infill.fill_in_middle(empty).count() == 0 and infill.fill_in_middle(empty).columns == ["doc_id", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output"]

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in every column, empty and long texts, ties and repeated rows."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeinorstlud"), rng.integers(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, copied = text(60), text(200)
    rows = [(i, f"{text(20)}\n{passage} {text(15)}", "en", f"s{i % 3}", 1) for i in range(8)]
    rows += [(100 + i, copied, "en", "s0", 1) for i in range(6)] + [(100, copied, "en", "s0", 1)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, text(30), None, "s1", 1), (202, " \t\n ", "", "", 3), (203, "x" * 20000, "fr", "s2", 20000), (204, text(5000), "de", "s2", 1), (205, "日本語テキスト😀 é", "ja", "s2", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """The documents as a table folder, with the other tables that the queries read."""
    d = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

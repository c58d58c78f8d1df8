"""Language ID, toxicity, extraction, search, pieces and the pipeline."""

import hashlib
import random
from collections import Counter

import duckdb
import held_out_pages
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from test_dedup import near_kept, removed
from reelmill.llm import balltree, extraction, langid, pieces, toxicity
from reelmill.llm.dom import leaf_blocks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return docs.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id")


def test_languages_of_texts_with_wrong_and_missing_declarations(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    rows = table[["doc_id", "text", "lang", "source"]].copy()
    truth = dict(zip(rows.doc_id, rows.lang))
    wrong = rows.doc_id % 10 == 0
    rows.loc[wrong, "lang"] = "fr"
    rows.loc[rows.doc_id % 10 == 1, "lang"] = None
    df = spark.createDataFrame(rows)
    got = langid.identify(df.withColumn("language", F.lit("kept")), "text", F.col("lang"), None, F.col("source"), narrow=True).collect()
    assert "language_" in got[0].asDict() and got[0].language == "kept"
    long = [r for r in got if len(table.text[r.doc_id]) > 100]
    assert np.mean([r.language_ == truth[r.doc_id] for r in long]) > 0.99


def test_language_of_odd_rows(spark, docs, empty):
    rows = {r.doc_id: r for r in langid.identify(docs, "text", F.col("lang"), F.lit("a.de"), F.col("source")).collect()}
    assert len(rows) == len({r.doc_id for r in docs.collect()}) and rows[3].language == "en" and rows[200].language
    assert langid.keep_identified(empty).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns


def slow_fusion(rows, model, weight=20.0):
    """Posteriors of (text, declared, address, host), one row after the other, with the model's likelihoods."""
    n = len(model.languages)
    like = [model.likelihood((r[0] or "").encode(), 200) for r in rows]
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    p = np.array([soft(z) for z in like])
    declared = [(r[1] or "").lower() for r in rows]
    suffix = [r[2].rsplit(".", 1)[1] if r[2] and "." in r[2] else "" for r in rows]
    host = [(r[3] or "").lower() for r in rows]
    domain = [".".join(h.split(".")[-2:]) for h in host]
    whole = p.sum(axis=0)
    by = lambda values: {v: p[[x == v for x in values]].sum(axis=0) for v in set(values)}

    def spoken(values):
        sums = by(values)
        return [np.log((sums[v] + weight * sums[v].sum() / whole.sum() + 1e-12) / (whole + weight + 1e-12)) for v in values]

    base = (whole + 1 / n) / (whole.sum() + 1)
    by_domain = {d: (c + weight * base) / (c.sum() + weight) for d, c in by(domain).items()}
    by_host, out = by(host), []
    for i, (a, b) in enumerate(zip(spoken(declared), spoken(suffix))):
        prior = (by_host[host[i]] + weight * by_domain[domain[i]]) / (by_host[host[i]].sum() + weight)
        out.append(soft(like[i] + np.log(prior) + a + b))
    return out


VOCABULARY = {"en": ["the", "and", "house", "river"], "de": ["der", "und", "haus", "fluss"], "fr": ["le", "et", "maison", "fleuve"]}


def some_text(rng):
    true = rng.choice(list(VOCABULARY))
    return true, " ".join(rng.choice(VOCABULARY[true]) for _ in range(rng.randint(0, 12)))


def test_fusion_matches_a_slow_version(spark):
    rng = random.Random(31)
    rows = []
    for i in range(240):
        true, text = some_text(rng)
        rows.append((i, text, rng.choice([true, true, true, "en", None]), rng.choice([None, f"x.{true}", "x.com"]), rng.choice([f"a.{true}.org", "b.org", "c.b.org", None])))
    df = spark.createDataFrame(rows, "id long, text string, lang string, address string, host string")
    got = {r.id: (r.language, r.confidence) for r in langid.identify(df, "text", F.col("lang"), F.col("address"), F.col("host")).collect()}
    model = langid.fit(df.withColumn("l", F.coalesce("lang", F.lit(""))), "text", "l", 20000)
    for i, post in enumerate(slow_fusion([r[1:] for r in rows], model)):
        assert abs(got[i][1] - post.max()) < 1e-6 and post[model.languages.index(got[i][0])] > post.max() - 1e-9


def test_language_query_matches_a_slow_version(spark, tmp_path):
    """Documents and pages through op1_langid, with the texts, markup, addresses and hosts that it takes from them."""
    rng = random.Random(32)
    docs, pages = [], []
    for i in range(120):
        true, text = some_text(rng)
        docs.append((i, text if i % 20 else None, rng.choice([true, true, "EN", None]), rng.choice(["web", "books", None]), 1))
        true, text = some_text(rng)
        host = rng.choice([f"www.{true}-news.{true}", "a.example.com", "example.com"])
        markup = rng.choice([true, true, None])
        pages.append((i, f"https://{host}/p/{i}", f"<html{f' lang={chr(34)}{markup}{chr(34)}' if markup else ''}><body><p>{text}</p></body></html>", host, markup, text))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = [(t, l, None, s) for _, t, l, s, _ in docs] + [(" " + f" {t} ", m, h, h) for *_, h, m, t in pages]
    df = spark.createDataFrame([(t, (l or "").lower()) for t, l, *_ in rows], "text string, l string")
    model = langid.fit(df, "text", "l", 20000, 5)
    got = {(r.doc_id, r.page_id): r for r in langid.op1_langid(spark, str(tmp_path)).collect()}
    assert len(got) == 240
    for key, row, post in zip([(i, None) for i in range(120)] + [(None, i) for i in range(120)], rows, slow_fusion(rows, model)):
        r = got[key]
        assert abs(r.confidence - post.max()) < 2e-6 and post[model.languages.index(r.language)] > post.max() - 1e-6
        assert r.declared == (row[1] or "").lower() and r.kept == (r.language != "und")


def test_thousands_of_declared_values_are_no_classes(spark):
    rng = random.Random(33)
    rows = [(some_text(rng)[1], f"junk{i}", "a") for i in range(5000)]
    for _ in range(300):
        true, text = some_text(rng)
        rows.append((text, true, "b"))
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    model = langid.fit(df, "text", "lang", 20000, 5)
    assert model.languages == ["de", "en", "fr", "und"] and model.table.nbytes < 1 << 20
    found = langid.identify(df, "text", F.col("lang"), None, F.col("source"))
    assert found.groupBy("language").count().count() <= 4 and found.count() == 5300


def test_every_declared_language_is_a_class(spark):
    rng = random.Random(8)
    rows = []
    for i in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(" ".join(rng.choice(words) for _ in range(60)), f"l{i:02}", "a") for _ in range(40 if i else 400)]
    rows += [(rows[-1][0], "l69", "a")] * 500
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    model = langid.fit(df, "text", "lang", 60)
    assert model.languages == [*(f"l{i:02}" for i in range(70)), "und"]
    rare = spark.createDataFrame([(f"some common words {i}", "en") for i in range(3000)] + [("etwas ganz anderes", "de"), ("noch ein text", "de")], "text string, lang string")
    assert langid.fit(rare, "text", "lang", 5).languages == ["de", "en", "und"]


def test_junk_is_no_language(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(["the", "and", "house", "river", "seemed", "older"]) for _ in range(60)), "en", "a") for i in range(40)]
    junk = [(100 + i, " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(5)) for _ in range(60)), None, "b") for i in range(3)]
    kept = langid.keep_identified(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))


def test_toxicity_on_held_out_rows(labelled):
    rows = labelled.sample(frac=1, random_state=3).reset_index(drop=True)
    y = np.stack([(rows.toxic == 1) | (rows.quality == 0), rows.toxic == 1, (rows.toxic == 1) & (rows.quality == 0)], axis=1).astype(int)
    cut = len(rows) * 2 // 3
    chain, _ = toxicity.fit_chain(rows.text[:cut].tolist(), y[:cut], ["unfit", "toxic", "toxic_low"])
    p = np.array([chain.predict(toxicity.tokens(t))[1] >= 0.5 for t in rows.text[cut:]])
    truth = y[cut:, 1] == 1
    english = (rows.lang[cut:] == "en").to_numpy()
    assert (p & ~truth).sum() <= 1 and (p & truth & english).sum() >= 0.7 * (truth & english).sum()


def test_later_models_learn_from_held_out_predictions():
    texts = ["good words here"] * 60 + ["vile words here"] * 40
    y = np.array([[0, 0]] * 60 + [[1, 1]] * 40)
    order = np.random.default_rng(0).permutation(100)
    chain, _ = toxicity.fit_chain([texts[i] for i in order], y[order], ["a", "b"])
    assert chain.predict(toxicity.tokens("vile"))[1] > 0.8 > 0.2 > chain.predict(toxicity.tokens("good"))[1]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_held_out_rows_leave_their_fold_alone(labelled):
    texts = labelled.text[:400].tolist()
    y = np.stack([labelled.toxic[:400] == 1, labelled.quality[:400] == 0], axis=1).astype(int)
    _, out = toxicity.fit_chain(texts, y, ["toxic", "low"], most_words=20)
    changed = y.copy()
    changed[0::5, 0] = 1 - changed[0::5, 0]  # the labels of fold 0
    _, other = toxicity.fit_chain(texts, changed, ["toxic", "low"], most_words=20)
    assert np.allclose(out[0::5, 0], other[0::5, 0]) and not np.allclose(out[1::5, 0], other[1::5, 0])


def test_chain_matches_a_slow_version(spark, labelled):
    texts = labelled.text.tolist()
    y = np.stack([labelled.toxic == 1, labelled.quality == 0], axis=1).astype(int)
    chain, out = toxicity.fit_chain(texts, y, ["toxic", "low"], most_words=30)
    words = sorted(chain.index, key=chain.index.get)
    x = np.array([[float(w in toxicity.tokens(t)) for w in words] for t in texts])
    first = toxicity.fit_linear(np.hstack((x, np.ones((len(texts), 1)))), y[:, 0].astype(float), 0.2)
    second = toxicity.fit_linear(np.hstack((x, out[:, :1], np.ones((len(texts), 1)))), y[:, 1].astype(float), 0.2)
    got = {r.id: r.toxicity for r in toxicity.predicted(spark.createDataFrame(list(enumerate(texts[:80])), "id long, text string"), chain).collect()}
    for i in range(80):
        p = 1 / (1 + np.exp(-(x[i] @ first[:-1] + first[-1])))
        q = 1 / (1 + np.exp(-(x[i] @ second[:-2] + second[-2] * p + second[-1])))
        assert np.allclose(got[i], [p, q], atol=1e-6)


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = toxicity.keep_clean(docs.withColumn("toxicity", F.lit(1)), labels)
    assert found.columns == [*docs.columns, "toxicity"]
    assert found.count() <= docs.count()
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == docs.count() and toxicity.keep_clean(empty, labels).count() == 0


@pytest.fixture(scope="module")
def field():
    return extraction.trained()


def test_blocks_of_a_page():
    page = "<title>T</title><script>var t='</p>';</script><nav><ul><li><a href=/a>A&amp;B</a></li></ul></nav><!-- x --><p><b>one<br>two &lt; 3<p>four\n five</p><style>p{}</style>six"
    assert [b.text for b in leaf_blocks(page)] == ["A&B", "one two < 3", "four five", "six"]
    assert leaf_blocks(page)[0].tags == ("nav", "ul", "li") and leaf_blocks(page)[0].linked == 1
    assert leaf_blocks("") == [] and leaf_blocks("<div") != None and [b.text for b in leaf_blocks("<p>a<script>x")] == ["a"]  # noqa: E711


def test_field_on_held_out_pages(field):
    rng = random.Random(77)
    right = blocks = 0
    for _ in range(150):
        html, labels = extraction.labelled_page(rng)
        found = leaf_blocks(html)
        if len(found) == len(labels):
            right += int((field.decode(extraction.features(found)) == np.array(labels)).sum())
            blocks += len(labels)
    assert right / blocks > 0.99


LAYOUTS = {
    "one paragraph": ("<html><body><p>The harbour was quiet after the storm, and the boats came back one by one.</p></body></html>", ["The harbour was quiet after the storm, and the boats came back one by one."]),
    "table": (
        "<html><body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><p>" + "The first paragraph tells a long story about rivers, bridges and mills. " * 7 + "</p><p>The second one is shorter, but it ends the story well, as it should.</p></td></tr></table></body></html>",
        [("The first paragraph tells a long story about rivers, bridges and mills. " * 7).strip(), "The second one is shorter, but it ends the story well, as it should."],
    ),
    "boxes": (
        "<div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>On mills</h1><div>Mills ground corn for centuries, driven by wind, by water, and later by steam.</div><div>Few of them still turn today, but those that do draw many visitors each year.</div></div><div>&copy; 2024 Some Press. All rights reserved.</div></div>",
        ["On mills", "Mills ground corn for centuries, driven by wind, by water, and later by steam.", "Few of them still turn today, but those that do draw many visitors each year."],
    ),
    "talk of another name": (
        "<nav><a href=1>One</a></nav><article><h1>On mills</h1><p>Mills ground corn for centuries, driven by wind, by water, and later by steam.</p><p>Few of them still turn today, but those that do draw many visitors.</p></article>"
        "<section class='reader-talk'><h3>3 comments</h3><div class=x1><p>I have seen one of them, near the coast, and it was lovely, really.</p></div><div class=x1><p>My grandfather was a miller, he would have liked this.</p></div></section>",
        ["On mills", "Mills ground corn for centuries, driven by wind, by water, and later by steam.", "Few of them still turn today, but those that do draw many visitors."],
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_not_trained_on(field, name):
    page, expected = LAYOUTS[name]
    assert extraction.main_text(page, field).split("\n\n") == expected


@pytest.mark.parametrize(("name", "page", "expected"), held_out_pages.pages())
def test_pages_written_by_hand(field, name, page, expected):
    assert extraction.main_text(page, field).split("\n\n") == expected


def test_precision_and_recall_on_pages_not_made_by_the_trainer(field):
    """By blocks, over ten variants of each layout; the README has the figures."""
    right = kept = wanted = 0
    for _, page, expected in held_out_pages.varied():
        got = Counter(extraction.main_text(page, field).split("\n\n"))
        right, kept, wanted = right + (got & Counter(expected)).total(), kept + got.total(), wanted + len(expected)
    print(f"precision {right / kept:.4f}, recall {right / wanted:.4f} of {wanted} blocks")
    assert right / kept > 0.98 and right / wanted > 0.98


@pytest.mark.parametrize("part", ["<a ", "<div>word", "<p>w<table>", "<!", "<select>", "</x>", '<a b="', "<script", "<li>x", "<b><i>"])
def test_long_broken_pages_take_linear_time(field, part):
    import time

    start = time.time()
    extraction.main_text(part * (10**6 // len(part)), field)
    assert time.time() - start < 20


def test_odd_tags():
    assert [b.text for b in leaf_blocks("<p>one <svg class=i/> two</p><p>three</p>")] == ["one two", "three"]
    assert [b.text for b in leaf_blocks("<p title=it's>It doesn't stop</p><p>here, it's so</p>")] == ["It doesn't stop", "here, it's so"]
    assert [b.text for b in leaf_blocks("<p>a < b</p><select><p>c")] == ["a < b", "c"]


def test_extraction_keeps_columns_and_takes_empty_tables(spark, field):
    df = spark.createDataFrame([(1, "<article><p>Some words of a page, and more.</p></article>", "own")] * 2 + [(None, None, None)], "id long, html string, text string")
    rows = extraction.extract(df, field=field).collect()
    assert rows[0].asDict() == {"id": 1, "text": "own", "text_": "Some words of a page, and more."} == rows[1].asDict() and rows[2]["text_"] == ""
    assert extraction.extract(df.limit(0), field=field).count() == 0


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.normal(size=(7, extraction.WIDTH))
        score = lambda y: field.s[y[0]] + sum((x[i] @ field.w) * y[i] for i in range(7)) + sum(field.t[y[i], y[i + 1]] for i in range(6))  # noqa: B023, E731
        best = max(([*map(int, f"{n:07b}")] for n in range(128)), key=score)
        assert field.decode(x).tolist() == best


def test_articles_of_pages(spark, field, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9003, "u", "<nav><a href=x>only a menu</a></nav>")], "page_id long, url string, html string")
    pages.unionByName(odd).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in extraction.op6_extraction(spark, str(tmp_path)).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        assert rows[r.page_id].text == "\n\n".join(b.text for b in leaf_blocks(inner)) and rows[r.page_id].n_chars == len(rows[r.page_id].text)
    assert [rows[i].text for i in (9001, 9002, 9003)] == ["", "", ""]


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 6)).astype(np.float32)
    x[100:300] = x[100]  # one vector many times
    x[50] = 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (750, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(float))
    for shard, block in ((100, 5), (10**6, 10**6)):
        got = {}
        for r in balltree.search(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard, block_rows=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert set(got) == set(range(0, 700, 50))
        for qid, best in got.items():
            s = v @ v[qid]
            order = [i for i in np.lexsort((np.arange(700), -s)) if i != qid][:5]
            assert [best[k] for k in range(1, 6)] == [(i, int(s[i])) for i in order]
    assert balltree.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_search_of_repeated_rows_matches_its_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(310)]
    rows += [rows[i] for i, n in ((0, 1), (50, 2), (100, 5), (150, 9)) for _ in range(n)]  # queries
    rows += [rows[i] for i in range(7, 300, 9) for _ in range(i % 8)]
    rows += [(200, [float(x) for x in 9 * rng.normal(size=4)]) for _ in range(8)]  # an id of several vectors
    rows += [(None, [float(x) for x in 3 * rng.normal(size=4)]) for _ in range(20)] + [(None, rows[3][1])] * 2
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = duckdb.connect()
    sql.execute(f"create view embeddings as from '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(sql.execute(balltree.OP9_SQL).fetchall(), key=str)
    assert len(expected) == 5 * 34
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    for shard, block in ((10**6, 2048), (60, 3)):
        found = balltree.search(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard, block_rows=block).collect()
        assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found), key=str) == expected


@pytest.mark.parametrize("size", [1e3, 1e8, 1e30, 1e160, 1e300])
def test_search_is_exact_for_large_components(spark, size):
    """Ids, order and cut scores of 600 rows in many shards against Python integers; ids 0, 50 and 100 stand twice."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([1, -1]) * rng.random() * (size if rng.random() < 0.6 else 1.0) for _ in range(5)]) for i in range(597)]
    rows += [(0, rows[0][1]), (50, [1.0, 2.0, 3.0, 4.0, 5.0]), (100, rows[7][1]), (999, [1e308] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows[:-1]]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    expected = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n)[:5]
            expected += [(q, k, i, cut(-s)) for k, (s, i) in enumerate(scored, 1)]
    found = balltree.search(df, F.col("vec_id") % 50 == 0, 5, shard_rows=50)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(expected)


def test_shards_of_a_cell_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(balltree, "MOST_CELLS", 2)
    rng = np.random.default_rng(6)
    x = np.floor(100 * rng.normal(size=(900, 4)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = balltree.integer_vectors(df, "vec_id", "embedding", 1).select("*", F.lit(1).cast("long").alias("times"), F.col("vec_id").alias("row"))
    pivots = balltree.pivots_of(rows, 2)
    built = balltree.trees(rows, pivots, 50).collect()
    assert len({r.cell for r in built}) == 2 and len(built) > 5 and max(len(balltree.BallTree.unpacked(r.tree).ids) for r in built) < 160
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in balltree.search(df, F.col("vec_id") % 50 == 0, 5, scale=1, shard_rows=50, waves=(1,)).collect()}
    for q in range(0, 900, 50):
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, int(scores[i])) for i in order]


def test_trees_survive_packing():
    rng = np.random.default_rng(4)
    x = np.floor(100 * rng.normal(size=(3000, 8)))
    tree = balltree.BallTree(np.arange(3000), x, np.ones(3000, np.int64), np.arange(3000))
    again = balltree.BallTree.unpacked(tree.packed())
    for i in range(0, 3000, 300):
        assert sorted(tree.search(i, x[i], 5, -np.inf)) == sorted(again.search(i, x[i], 5, -np.inf))


def slow_viterbi(vocabulary, scores, word):
    best = [(0.0, [])] + [(-np.inf, None)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):  # longer pieces first
            piece = word[start:end]
            s = scores.get(piece, (vocabulary.unknown, None) if end - start == 1 else None)
            if s is not None and best[start][0] + s[0] > best[end][0]:
                best[end] = best[start][0] + s[0], [*best[start][1], s[1] if s[1] is not None else piece]
    return best[-1][1]


def test_pieces_match_a_slow_viterbi_and_round_trip():
    v = pieces.Vocabulary.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    scores = {model.IdToPiece(i): (model.GetScore(i), i) for i in range(model.GetPieceSize()) if not (model.IsByte(i) or model.IsControl(i) or model.IsUnknown(i))}
    texts = [t[:200] for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:150]] + ["", " ", "a  b\n c", "日本語 テキスト😀", "▁ x ▁▁", "\t", "x" * 100, "é日" * 3000 + "the" * 2000]
    for t, found in zip(texts, pieces.Encoder(v).encode(texts)):
        ids = found.tolist()
        assert v.decode(ids) == t and v.decode(ids) == (model.decode(ids) if "▁" not in t and "�" not in t else t)
        if len(t) <= 200 and "▁" not in t:
            slow = []
            for w in v.split(t) if t else []:
                for p in slow_viterbi(v, scores, w):
                    slow += [p] if isinstance(p, int) else [v.byte_ids[b] for b in p.encode()]
            assert slow == ids


def test_piece_columns(spark, docs, empty):
    rows = {r.doc_id: r for r in pieces.encode(docs.withColumn("ids", F.lit(3)), back_col="back").collect()}
    assert all(r.back == r.text and (r["ids_"] is None) == (r.text is None) and r["ids"] == 3 for r in rows.values()) and rows[201]["ids_"] == []
    assert [r.t for r in pieces.decode(pieces.encode(docs.where("doc_id = 205")), out_col="t").collect()] == ["日本語テキスト😀 é"]
    assert pieces.encode(empty).count() == 0


def test_decoding_of_odd_ids(spark):
    rows = [(1, [None, 300, None]), (2, [300, -1, 10**6, 300]), (3, []), (4, None), (5, [None])]
    got = {r.i: r.decoded for r in pieces.decode(spark.createDataFrame(rows, "i int, ids array<int>")).collect()}
    one = pieces.Vocabulary.load().decode([300])
    whole = pieces.Vocabulary.load().decode([300, 300])
    assert got[1] == one and got[2].startswith(one) and got[2].count("\ufffd") == 2 and got[2].replace("\ufffd", "") == whole and got[3] == "" and got[4] is None and got[5] == ""


def test_pieces_query_matches_a_slow_viterbi(spark, docs, folder):
    v = pieces.Vocabulary.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    scores = {model.IdToPiece(i): (model.GetScore(i), i) for i in range(model.GetPieceSize()) if not (model.IsByte(i) or model.IsControl(i) or model.IsUnknown(i))}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    got = {r.doc_id: r for r in pieces.op10_pieces(spark, folder).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len(texts) + 1
    for i, t in texts.items():
        if t is None or len(t) > 2000:
            continue
        slow = [x for w in (v.split(t) if t else []) for p in slow_viterbi(v, scores, w) for x in ([p] if isinstance(p, int) else [v.byte_ids[b] for b in p.encode()])]
        assert (got[i].n_chars, got[i].n_ids, got[i].ids_md5) == (len(t), len(slow), hashlib.md5(" ".join(map(str, slow)).encode()).hexdigest())


def test_toxicity_query_matches_its_chain_row_by_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    chain = toxicity.train(docs, labels, toxicity.label_categories())
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        p = chain.predict(toxicity.tokens(r.text))
        assert np.allclose([got[r.doc_id][c] for c in chain.categories], p) and got[r.doc_id].is_toxic == (p[1] >= 0.5)


def test_pipeline_stages(spark, tmp_path):
    """Every stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    now, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        texts[name] = {r.doc_id: r.text for r in now.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    spoken = {r.doc_id: r.language for r in langid.identify(docs, "text", F.col("lang"), None, F.col("source")).collect()}
    assert texts["language_id"] == {i: t for i, t in before.items() if spoken[i] != "und"}
    kept = docs.where(F.col("doc_id").isin(list(texts["language_id"])))
    chain = toxicity.train(kept, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.label_categories())
    assert texts["toxicity"] == {i: t for i, t in texts["language_id"].items() if chain.predict(toxicity.tokens(t))[1] < 0.5}
    ids = sorted(texts["toxicity"])
    assert sorted(texts["simhash_near_dedup"]) == [ids[i] for i in near_kept([texts["toxicity"][i] or "" for i in ids])]
    ids = sorted(texts["simhash_near_dedup"])
    for i, (n, gone, sha) in zip(ids, removed([texts["simhash_near_dedup"][i] for i in ids], 35)):
        assert hashlib.sha256(" ".join((texts["substring_dedup"][i] or "").split()).encode()).hexdigest() == sha
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    placed = Counter()
    for r in out:
        placed[r.doc_id] += r.length
    assert placed == Counter({i: len(t or "") for i, t in texts["substring_dedup"].items()}) and set(placed) == set(texts["substring_dedup"])
    assert len({(r.pack, r.bin, r.offset) for r in out if r.length}) == len([r for r in out if r.length])


def test_pipeline_of_odd_and_empty_tables(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs.withColumns({"fingerprint": F.lit(1), "language": F.lit("x"), "key_x": F.lit(2)})), ("empty", empty)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in table.collect()} and bool(rows) == (name == "odd")

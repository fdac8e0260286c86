"""Word vectors as a method of every search, the versioned store, judgments from titles."""

import pytest
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.operators import evaluate, models, vectors
from quarry.plans import search as S
from quarry.session import shared_dir
from quarry.sources import files, store

ENC = models.HashEncoder()
TEXTS = ["solar robot arm", "robot robot vision system", "banana leaf disease", None, "", "solar banana robot!", "x 9y"]
WORDS = [("solar", [1.0, 0.0, 2.0]), ("robot", [0.0, 3.0, 1.0]), ("banana", [5.0, 1.0, 0.0]), ("vision", [2.0, 2.0, 2.0])]


def corpus(spark, copies=30):
    rows = [(i * 10 + j, t) for i in range(copies) for j, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, content string")


def model(spark):
    return spark.createDataFrame(WORDS, "word string, vector array<float>")


@pytest.mark.parametrize("width", [1, 4, 17])
def test_word_vectors_do_not_depend_on_how_the_input_is_dealt(spark, monkeypatch, width):
    docs, wv = corpus(spark), model(spark)
    want = sorted(map(tuple, vectors.long_form(vectors.word_vector_embed(docs, wv), "doc_id").collect()))
    assert len(want) == docs.count() * 3
    dealt = docs.repartition(width, "doc_id")
    for model_bytes in (vectors.MODEL_BYTES, 0):          # broadcast model, salted shuffle join
        monkeypatch.setattr(vectors, "MODEL_BYTES", model_bytes)
        got = vectors.long_form(vectors.word_vector_embed(dealt, wv), "doc_id").collect()
        assert sorted(map(tuple, got)) == want
    one = spark.createDataFrame([(1, "solar robot solar zz")], "doc_id long, content string")
    assert vectors.word_vector_embed(one, wv).first()["embedding"] == pytest.approx([0.8, 0.6, 1.8])


def test_word_vector_corpora(spark):
    """Statistics of a corpus, and of each query's answers by themselves."""
    docs, wv = corpus(spark, 3), model(spark)
    some = docs.filter("doc_id < 10")
    whole = {r.doc_id: r.embedding for r in vectors.word_vector_embed(docs, wv).collect()}
    part = {r.doc_id: r.embedding for r in vectors.word_vector_embed(some, wv, corpus=docs).collect()}
    assert part == {i: pytest.approx(whole[i]) for i in part} and len(part) == 7
    hyp = spark.createDataFrame([(1, 0, "solar robot"), (1, 1, "robot"), (2, 0, "solar solar banana")],
                                "query_id long, n int, text string")
    qs = spark.createDataFrame([(1, "a", 3), (2, "b", 3)], "query_id long, query string, top_k int")
    got = {r.query_id: r.embedding for r in S.hyde_query_vectors(qs, hyp, vectors.WordVectorEncoder(wv)).collect()}
    alone = vectors.word_vector_embed(hyp.filter("query_id = 1").select(F.col("n").alias("doc_id"), F.col("text").alias("content")), wv)
    a, b = [r.embedding for r in alone.orderBy("doc_id").collect()]
    assert got[1] == pytest.approx([(x + y) / 2 for x, y in zip(a, b, strict=True)])
    assert got[2] == pytest.approx([(4 * 1 + 5) / 5, 1 / 5, 8 / 5])


def test_word_vectors_in_search_store_and_times(spark):
    docs, wv = corpus(spark, 2), model(spark)
    qs = spark.createDataFrame([(1, "banana", 2), (2, "robot vision", 2), (3, "nothing known", 2)],
                               "query_id long, query string, top_k int")
    words = vectors.WordVectorEncoder(wv)
    run = S.search(docs, qs, SearchConfig(), words)
    first = {r.query_id: r.doc_id for r in run.filter("rank = 1").collect()}
    assert first == {1: 2, 2: 1}                         # a query without a known word has no direction
    path = shared_dir(spark, "word_store")
    S.get_or_create_embeddings(docs, words, path, "words")
    S.get_or_create_embeddings(docs, ENC, path, "hash")
    methods = {"words": S.Method(words, store=path, stored_as="words"), "hash": S.Method(ENC, store=path, stored_as="hash")}
    cfg = {"plain": SearchConfig(), "fused": SearchConfig(use_bm25=True)}
    runs = S.search_many(docs, qs, cfg, methods=methods)
    assert {r[0] for r in runs.select("method").distinct().collect()} == {"words plain", "words fused", "hash plain", "hash fused"}
    assert sorted(map(tuple, runs.filter("method = 'words plain'").drop("method").select(*run.columns).collect())) == sorted(map(tuple, run.collect()))
    times = S.search_times(docs, qs, {"plain": SearchConfig()}, methods, iterations=1).collect()
    assert sorted(r["method"] for r in times) == ["hash plain", "words plain"] and all(r["runtime_ms"] > 0 and r["queries"] == 3 for r in times)


def test_store_writes_only_changed_rows_and_readers_see_whole_states(spark):
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(40)], "doc_id long, content string")
    path = shared_dir(spark, "versions")
    S.get_or_create_embeddings(docs, ENC, path, "a/b *")
    before = store.read_versions(spark, path, "a/b *")              # a reader that began here
    old = sorted(map(tuple, before.select("doc_id", "content_hash").collect()))
    changed = docs.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content")))
    changed = changed.unionByName(spark.createDataFrame([(99, "more")], "doc_id long, content string"))
    out = {r.doc_id: r.reused for r in S.get_or_create_embeddings(changed, ENC, path, "a/b *").collect()}
    assert sorted(i for i, r in out.items() if not r) == [0, 10, 20, 30, 99] and len(out) == 41
    assert store.live_versions(spark, path, "a/b *") == [1, 2]
    folder = store._folder(path, "a/b *")
    assert spark.read.parquet(f"{folder}/version=2").count() == 5   # only what changed was written
    now = files.load_embeddings(spark, path, "a/b *")
    assert now.count() == now.select("doc_id").distinct().count() == 41
    # An unfinished write: files, but no manifest.
    now.select(*store.STORED).limit(3).write.parquet(f"{folder}/version=7")
    assert store.live_versions(spark, path, "a/b *") == [1, 2]
    S.get_or_create_embeddings(changed, ENC, path, "a/b *", force=True)
    assert store.live_versions(spark, path, "a/b *") == [8]
    assert sorted(map(tuple, before.select("doc_id", "content_hash").collect())) == old
    store.write_version(now.filter("doc_id < 5").select("doc_id", "content_hash", "embedding"), path, "a/b *")
    store.compact(spark, path, "a/b *")
    assert len(store.live_versions(spark, path, "a/b *")) == 1
    assert files.load_embeddings(spark, path, "a/b *").count() == 41
    norms = files.load_embeddings(spark, path).select(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(r.n is None or abs(r.n - 1) < 1e-12 for r in norms)
    with pytest.raises(ValueError):
        files.load_embeddings(spark, path, "none")
    with pytest.raises(ValueError, match="duplicate"):
        S.get_or_create_embeddings(docs.unionByName(docs), ENC, path, "twice")


def test_title_judgments(spark):
    docs = spark.createDataFrame([("A", "x"), ("B", "y")], "doc_id string, content string")
    lists = spark.createDataFrame([(1, ["A", "A", "unknown", None]), (2, ["B", "A"]), (3, []), (4, None)],
                                  "query_id long, titles array<string>")
    got = sorted(map(tuple, evaluate.title_judgments(lists, docs).collect()))
    assert got == [(1, "A"), (2, "A"), (2, "B")]


def test_character_references_as_the_standard_library(spark):
    import html
    import random

    from quarry.sources import pages

    rng = random.Random(5)
    parts = ["&", "amp", ";", "#", "x", "41", "0", "notin", "not", "gt", "GT", "nbsp;", " ", "&#128;", "&#x80;", "&#0;",
             "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000000065;", "&#xFFFE;", "&#x1F600", "&#11;",
             "&#1", "&#x7f;", "&#13;", "&#xFDD0;", "&copycat", "&NotEqualTilde;", "&nosuch;", "&\U0001F600;", "\r\n", "é", "&lt"]
    texts = ["", "&", "&&", "&;", "&#;", "&#x;", "no reference", None,
             *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(800))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", pages.unescape("t").alias("u"))
    got = {r.i: r.u for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else html.unescape(t)), t
    pages_df = spark.createDataFrame([(1, "http://h/", "<article><h1>&eacute;</h1></article>")], "page_id long, url string, html string")
    plan = pages.extract_pages(pages_df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEval" not in plan


def test_prompt_template_is_a_parameter(spark):
    from quarry.functions.text import render_prompt

    df = spark.createDataFrame([("Why?",), (None,)], "q string")
    got = [r.p for r in df.select(render_prompt("q", "Q={question};").alias("p")).collect()]
    assert got == ["Q=Why?;", "Q=;"]
    with pytest.raises(ValueError):
        render_prompt("q", "no slot")


def test_word_filter_of_a_large_model(spark):
    words = spark.range(20_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("word"))
    passing = vectors.word_filter(words, 20_000)
    assert passing(words).distinct().count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("word"))
    assert passing(others).count() < 20_000 / 10
    model = spark.createDataFrame([(f"w{chr(97 + i)}", [float(i), 1.0]) for i in range(0, 20, 2)], "word string, vector array<double>")
    docs = spark.createDataFrame([(d, " ".join(f"w{chr(97 + (d * 7 + j) % 20)}" for j in range(9))) for d in range(12)],
                                 "doc_id long, content string")
    both = [sorted((r.doc_id, [round(x, 9) for x in r.embedding]) for r in vectors.word_vector_embed(
        docs, model, stop_words=[], max_broadcast_rows=most).collect()) for most in (100, 0)]
    assert both[0] == both[1] and len(both[0]) == 12 and any(any(v) for _, v in both[0])


def test_word_vectors_in_blocks(spark, monkeypatch):
    """No (document, word) row leaves a block; rows of an id count together, without one alone."""
    wv = model(spark)
    docs = spark.createDataFrame([(1, "solar robot"), (1, "solar zz"), (2, "banana"), (3, None), (None, "robot"), (4, "zz")],
                                 "doc_id long, content string")
    alike = spark.createDataFrame([(1, "solar robot solar zz")], "doc_id long, content string")
    one = vectors.word_vector_embed(alike, wv, corpus=docs).first()["embedding"]
    for block_bytes in (vectors.BLOCK_BYTES, 8):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
        out = vectors.word_vector_embed(docs, wv)
        got = {(r.doc_id, tuple(round(x, 9) for x in r.embedding)) for r in out.collect()}
        assert {i for i, _ in got} == {1, 2, 3, 4, None} and out.count() == 6
        zeros = {i for i, v in got if not any(v)}
        assert zeros == {3, 4, None} and (1, tuple(round(x, 9) for x in one)) in got and len(got) == 5
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan

"""Paths outside the given rows: stores, text ids, lengths, defaults, short passages."""

import pytest

from quarry.config import SearchConfig
from quarry.operators import evaluate, models, prep
from quarry.operators.bm25 import bm25_search, build_bm25_index
from quarry.operators.dense import cosine_candidates, dense_search
from quarry.operators.passages import containing_documents
from quarry.plans import search as S
from quarry.session import shared_dir
from quarry.sources import files, pages
from quarry.sources import tables as T

ENC = models.hash_encoder()


def counting_encoder(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        predict = ENC()

        def run(texts):
            seen.add(len(texts))
            return predict(texts)
        return run
    return make, seen


def test_unfinished_csv_is_rewritten(spark):
    df = spark.createDataFrame([("a", "x", "u", None), ("b", "y", "u", None)], files.PAPERS_SCHEMA)
    path = shared_dir(spark, "unfinished")
    df.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").csv(path)
    assert not files.is_complete(spark, path)
    files.write_papers(df, path)
    assert files.read_papers(spark, path).count() == 2 and files.is_complete(spark, path)


def test_store_read_errors_rise(spark):
    path = shared_dir(spark, "broken_store")
    spark.createDataFrame([("x",)], "value string").write.text(f"{path}/method=hash")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, content string")
    with pytest.raises(Exception):  # noqa: B017  (a file that is no Parquet)
        S.get_or_create_embeddings(docs, ENC, path, "hash").count()
    with pytest.raises(Exception, match="(?i)no filesystem|unsupported|scheme"):
        files.is_complete(spark, "nosuchfs://host/path")


def test_store_by_method_and_text_id(spark):
    path = shared_dir(spark, "title_store")
    docs = spark.createDataFrame([("Solar arms", "solar robot arm"), ("Leaves", "banana leaf disease"), ("Empty", None)],
                                 "doc_id string, content string")
    S.get_or_create_embeddings(docs, ENC, path, "007")
    S.get_or_create_embeddings(docs, models.hash_encoder(4), path, "b")
    changed = docs.replace("banana leaf disease", "banana leaf virus", ["content"])
    out = {r["doc_id"]: r["reused"] for r in S.get_or_create_embeddings(changed, ENC, path, "007").collect()}
    assert out == {"Solar arms": True, "Leaves": False, "Empty": True}
    assert files.load_embeddings(spark, path, "007").count() == 3
    S.get_or_create_embeddings(changed, ENC, path, "007", force=True)
    assert sorted(r["method"] for r in files.list_methods(spark, path).collect()) == ["007", "b"]
    assert files.load_embeddings(spark, path, "b").count() == 3
    qs = spark.createDataFrame([("q", "banana leaf virus", None)], "query_id string, query string, top_k int")
    index = shared_dir(spark, "title_index")
    build_bm25_index(changed, index)
    for cfg in (SearchConfig(), SearchConfig(use_bm25=True)):
        run = S.search(changed, qs, cfg, ENC, store=path, method="007", bm25_index=index)
        assert run.filter("rank = 1").first()["doc_id"] == "Leaves"
    with pytest.raises(ValueError):
        S.search(changed, qs, SearchConfig(), ENC, store=path, method="none")


def test_each_text_is_encoded_once(spark):
    make, seen = counting_encoder(spark)
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(30)], "doc_id long, content string")
    qs = spark.createDataFrame([(i, f"word{i}", 3) for i in range(4)], "query_id long, query string, top_k int")
    hyp = spark.createDataFrame([(i, 0, f"word{i} other") for i in range(4)], "query_id long, n int, text string")
    cfg = {"plain": SearchConfig(), "hyde": SearchConfig(use_hyde=True)}
    S.search_many(docs, qs, cfg, make, hypotheses=hyp).collect()
    assert seen.value == 30 + 4 + 4


def test_mixed_vector_lengths(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [1.0, 2.0, 3.0])],
                                 "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(1, [1.0, 1.0], 10), (2, [1.0, 2.0, 3.0], 10), (3, [1.0], 10)],
                               "query_id long, embedding array<float>, top_k int")
    got = {}
    for r in dense_search(docs, qs).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == {1: {0, 1, 2, 3, 4}, 2: {9}}


def test_running_best_per_partition(spark):
    docs = spark.createDataFrame([(i, [float(i % 13), 1.0]) for i in range(3000)],
                                 "doc_id long, embedding array<float>").coalesce(1)
    qs = spark.createDataFrame([(1, [1.0, 0.0], 10)], "query_id long, embedding array<float>, top_k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        assert cosine_candidates(docs, qs, 10).count() == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_top_k_is_the_default(spark):
    docs = spark.createDataFrame([(i, f"robot w{i}") for i in range(30)], "doc_id long, content string")
    qs = spark.createDataFrame([(1, "robot", None), (2, "robot", 3)], "query_id long, query string, top_k int")
    counts = {r["query_id"]: r["count"] for r in bm25_search(docs, qs).groupBy("query_id").count().collect()}
    assert counts == {1: 10, 2: 3}


def test_missing_content_is_not_searched(spark):
    docs = spark.createDataFrame([(1, None), (2, "robot"), (3, "")], "doc_id long, content string")
    qs = spark.createDataFrame([(1, "robot", 10)], "query_id long, query string, top_k int")
    assert [r["doc_id"] for r in bm25_search(docs, qs).orderBy("rank").collect()] == [2, 3]


def test_wide_bm25_has_no_pair_shuffle(spark):
    docs, qs = (f(spark, "/root/testdata/sf0.001") for f in (T.documents, T.queries))
    plan = bm25_search(docs, qs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x]
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "documents.parquet" in x]
    assert len(scans) == 1  # the other pass counts the corpus


def test_blocks_of_queries_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3}") for i in range(40)], "doc_id long, content string")
    qs = spark.createDataFrame([(q, f"w{q % 7} alpha", 5) for q in range(9)], "query_id long, query string, top_k int")
    one = sorted(map(tuple, bm25_search(docs, qs).collect()))
    assert one == sorted(map(tuple, bm25_search(docs, qs, max_broadcast_rows=4).collect())) and len(one) == 45


def test_short_passages(spark, monkeypatch):
    monkeypatch.setattr("quarry.operators.passages.SHORT_BLOCK", 2)
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quickly done"), (3, None)], "doc_id long, content string")
    ps = spark.createDataFrame([(10, "quick"), (11, "ck br"), (12, "zz"), (13, "he quick brown fo"), (14, None), (15, "!")],
                               "query_id long, passage string")
    got = sorted(map(tuple, containing_documents(docs, ps).collect()))
    assert got == [(10, 1), (10, 2), (11, 1), (13, 1)]


def test_listing_and_similarity_keep_every_rank(spark):
    docs = spark.createDataFrame([(1, "a"), (3, "c")], "doc_id long, content string")
    qs = spark.createDataFrame([(7, "a c", 3)], "query_id long, query string, top_k int")
    run = spark.createDataFrame([(7, 1, 1, 0.9), (7, 2, 99, 0.8), (7, 3, 3, 0.7)], "query_id long, rank int, doc_id long, score double")
    out = S.search_listing(S.attach_similarity(run, docs, qs, models.jaccard_scorer()), docs).orderBy("rank").collect()
    assert [(r["rank"], r["content"]) for r in out] == [(1, "a"), (2, None), (3, "c")]
    assert out[1]["similarity"] is None and out[0]["similarity"] is not None


def test_method_without_results_keeps_its_rows(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, content string")
    runs = spark.createDataFrame([("m", 1, 1, "a")], "method string, query_id long, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "a")], "query_id long, doc_id string")
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = evaluate.metrics_per_query(runs, qrels, docs, qs, ["m", "silent"]).collect()
    assert sorted((r["method"], r["query_id"], r["retrieved"]) for r in got) == [
        ("m", 1, 1), ("m", 2, 0), ("silent", 1, 0), ("silent", 2, 0)]


def test_every_user_turn_is_a_query(spark):
    sf = "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    qs, hyp = T.conversation_queries(spark, sf), T.hypotheses(spark, sf)
    assert qs.count() == conv.filter("role = 'user'").count() == qs.select("query_id").distinct().count()
    assert hyp.join(qs, "query_id", "left_anti").count() == 0


def test_all_character_references(spark):
    df = spark.createDataFrame([("&copy;&#233;&#x1F600; &amp;lt; &nbsp;x", ), (None,)], "t string")
    got = [r[0] for r in df.select(pages.unescape("t")).collect()]
    assert got == ["©é😀 &lt; \xa0x", None]


def test_select_method_names_unknown(spark):
    with pytest.raises(ValueError):
        prep.select_method(spark.createDataFrame([("a", 1)], "method string, x int"), "b")

"""BM25L goldens (worked examples) and edge cases."""

from pyspark.sql import functions as F

from quarry.operators.bm25 import bm25_search


def _q(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string, top_k int")


def _scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_single_term_golden(spark, toy_docs):
    out = bm25_search(toy_docs, _q(spark, [(1, "robot", 10)]))
    assert _scores(out) == {1: 0.602965, 2: 0.703639, 3: 0.293752}
    ranks = {r.doc_id: r.rank for r in out.collect()}
    assert ranks == {2: 1, 1: 2, 3: 3}


def test_two_term_golden(spark, toy_docs):
    out = bm25_search(toy_docs, _q(spark, [(1, "robot leaf", 10)]))
    assert _scores(out) == {1: 1.215983, 2: 1.316657, 3: 1.552053}


def test_unknown_blank_and_repeated(spark, toy_docs):
    qs = _q(spark, [(1, "zzz", 10), (2, "", 10), (3, "   ", 10), (4, "robot robot ROBOT", 10)])
    out = bm25_search(toy_docs, qs)
    by_q = {}
    for r in out.collect():
        by_q.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert 1 not in by_q and 2 not in by_q and 3 not in by_q
    assert by_q[4] == {1: 0.602965, 2: 0.703639, 3: 0.293752}


def test_top_k_above_corpus_and_per_query_k(spark, toy_docs):
    out = bm25_search(toy_docs, _q(spark, [(1, "robot", 50), (2, "robot", 1)]))
    counts = {r.query_id: r.n for r in out.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 3, 2: 1}


def test_unmatched_documents_fill_by_lowest_id(spark):
    docs = spark.createDataFrame([(i, "alpha" if i == 7 else f"word{i} other") for i in range(1, 30)],
                                 "doc_id long, content string")
    out = bm25_search(docs, _q(spark, [(1, "alpha", 4)])).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [7, 1, 2, 3]
    assert out[0].score > out[1].score == out[2].score == out[3].score


def test_plan_limits_before_shuffle(spark, toy_docs):
    out = bm25_search(toy_docs, _q(spark, [(1, "robot", 10)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "MapInArrow" in plan          # a task's documents meet a block of queries, no join
    assert not [x for x in plan.splitlines() if "Exchange" in x and "doc_id" in x]
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_many_queries_path_equals_broadcast_path(spark):
    docs = spark.createDataFrame([(i, " ".join(["the"] * (i % 3 + 1) + [f"w{i % 7}", "robot" if i % 4 == 0 else "arm"]))
                                  for i in range(60)], "doc_id long, content string")
    qs = _q(spark, [(q, f"the w{q % 7} robot", 5) for q in range(12)] + [(99, "zzz", 5)])
    small = sorted(map(tuple, bm25_search(docs, qs).collect()))
    big = sorted(map(tuple, bm25_search(docs, qs, max_broadcast_rows=0).collect()))
    assert small == big and len(small) == 60


def test_stored_index_equals_direct(spark, toy_docs):
    from quarry.operators.bm25 import bm25_search_index, build_bm25_index
    from quarry.session import shared_dir

    path = shared_dir(spark, "test_bm25_index")
    build_bm25_index(toy_docs, path, buckets=4)
    qs = _q(spark, [(1, "robot leaf", 10), (2, "zzz", 10), (3, "robot", 2)])
    direct = sorted(map(tuple, bm25_search(toy_docs, qs).collect()))
    stored = bm25_search_index(spark, path, qs)
    assert sorted(map(tuple, stored.collect())) == direct
    plan = stored._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"PartitionFilters: \[term_bucket#\d+ (INSET|IN)", plan)


def test_stored_index_counts_empty_documents(spark):
    from quarry.operators.bm25 import bm25_search_index, build_bm25_index
    from quarry.session import shared_dir

    docs = spark.createDataFrame([(1, "solar robot arm"), (2, ""), (3, "!! ?"), (4, None), (5, "robot")],
                                 "doc_id long, content string")
    path = shared_dir(spark, "test_bm25_index_empty")
    build_bm25_index(docs, path, buckets=3)
    qs = _q(spark, [(1, "robot", 10), (2, "arm", 2)])
    assert sorted(map(tuple, bm25_search_index(spark, path, qs).collect())) == \
        sorted(map(tuple, bm25_search(docs, qs).collect()))


def test_index_skips_blocks_and_shuffles_no_pairs(spark):
    import pyarrow as pa

    from quarry.config import Bm25Params
    from quarry.operators import bm25
    from quarry.session import shared_dir

    docs = spark.createDataFrame([(i, " ".join(["the"] * (i % 5 + 1) + [f"w{i % 11}"] * (i % 3) + ["pad"] * (i % 40)))
                                  for i in range(600)], "doc_id long, content string")
    path = shared_dir(spark, "test_bm25_blocks")
    bm25.build_bm25_index(docs, path, buckets=3, block_docs=8)
    qs = _q(spark, [(1, "the w3", 5), (2, "the", 3), (3, "w7 pad", 10), (4, "zzz", 4), (5, "w1 w2", 300)])
    out = bm25.bm25_search_index(spark, path, qs)
    want = sorted(map(tuple, bm25.bm25_search(docs, qs).collect()))
    assert sorted(map(tuple, out.collect())) == want
    # More than one block of queries, and no broadcast.
    before, bm25.BLOCK_PAIRS = bm25.BLOCK_PAIRS, 2
    try:
        split = bm25.bm25_search_index(spark, path, qs, max_broadcast_rows=0)
        assert sorted(map(tuple, split.collect())) == want
    finally:
        bm25.BLOCK_PAIRS = before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "doc_id" in x]
    # One tile of all blocks: the best 3 for "the" need few of them.
    rows = spark.read.parquet(f"{path}/postings").filter("term = 'the'").toArrow()
    n_docs, avg_len = 600, spark.read.parquet(f"{path}/stats").first()["avg_len"]
    tile = bm25._Tile(rows, avg_len, Bm25Params())
    top = tile.best([("the", 1.0)], 0.0, 3)
    assert tile.met >= n_docs // 8 and tile.scored * 2 < tile.met
    every = bm25._Tile(rows, avg_len, Bm25Params())
    assert every.best([("the", 1.0)], 0.0, n_docs)[:3] == top and every.scored == every.met
    assert isinstance(rows, pa.Table)


def test_index_ids_of_text_and_empty_corpus(spark):
    from quarry.operators.bm25 import bm25_search_index, build_bm25_index
    from quarry.session import shared_dir

    docs = spark.createDataFrame([("b", "robot arm"), ("a", "robot arm"), ("c", ""), (None, "robot")],
                                 "doc_id string, content string")
    qs = _q(spark, [(1, "robot", 10)])
    path = shared_dir(spark, "test_bm25_text_ids")
    build_bm25_index(docs, path)
    got = bm25_search_index(spark, path, qs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25_search(docs, qs).collect()))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b", "c"]
    empty = shared_dir(spark, "test_bm25_empty_corpus")
    build_bm25_index(docs.limit(0), empty)
    assert bm25_search_index(spark, empty, qs).count() == 0

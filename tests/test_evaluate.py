"""Metric goldens and NULL paths."""

from quarry.operators import evaluate


def _setup(spark):
    docs = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(8)]
                                 + [("g1", "t g1"), ("g2", "t g2"), ("g3", "t g3"), ("x", "t x"), ("y", "t y")],
                                 "doc_id string, content string")
    qrels = spark.createDataFrame([(1, "g1"), (1, "g2"), (1, "g3"), (1, "g3"), (1, "missing")],
                                  "query_id long, doc_id string")
    runs = spark.createDataFrame([("m", 1, 1, "g1"), ("m", 1, 2, "x"), ("m", 1, 3, "g2"), ("m", 1, 4, "y")],
                                 "method string, query_id long, rank int, doc_id string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    return docs, qrels, runs, queries


def test_metric_goldens(spark):
    docs, qrels, runs, queries = _setup(spark)
    assert docs.count() == 13
    m = {r.query_id: r for r in evaluate.metrics_per_query(runs, qrels, docs, queries).collect()}
    r = m[1]
    assert (r.retrieved, r.relevant, r.ground_truth, r.corpus) == (4, 2, 3, 13)
    assert round(r.precision, 6) == 0.5
    assert round(r.recall, 6) == 0.666667
    assert round(r.fallout, 6) == 0.2
    assert round(r.f1, 6) == 0.571429
    assert round(r.f2, 6) == 0.625
    assert round(r.ap, 6) == 0.833333
    assert round(r.ndcg, 6) == 0.703918
    assert round(r.recall_multi_hit, 6) == 0.666667
    # query 2: nothing retrieved, no truth -> undefined ratios are NULL, rest 0
    e = m[2]
    assert e.retrieved == 0 and e.precision is None and e.recall is None and e.f1 is None
    assert e.ndcg == 0.0 and e.ap == 0.0


def test_per_method_mean_skips_null(spark):
    docs, qrels, runs, queries = _setup(spark)
    per = evaluate.metrics_per_query(runs, qrels, docs, queries)
    row = evaluate.metrics_per_method(per).first()
    assert row.queries == 2
    assert round(row.precision, 6) == 0.5          # NULL of query 2 left out
    assert round(row.ndcg, 6) == round(0.703918 / 2, 6)


def test_ideal_dcg_chunks(spark):
    counts = spark.createDataFrame([(1, 10000), (2, 3)], "query_id long, n_truth long")
    got = {r.query_id: r.idcg for r in evaluate.ideal_dcg(counts, chunk=97).collect()}
    import math
    assert abs(got[1] - sum(1 / math.log2(i + 1) for i in range(1, 10001))) < 1e-9
    assert abs(got[2] - (1 + 1 / math.log2(3) + 0.5)) < 1e-12


def test_content_match_counts_copies(spark):
    docs = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", "other")], "doc_id string, content string")
    qrels = spark.createDataFrame([(1, "a")], "query_id long, doc_id string")
    runs = spark.createDataFrame([("m", 1, 1, "b"), ("m", 1, 2, "c")],
                                 "method string, query_id long, rank int, doc_id string")
    r = evaluate.metrics_per_query(runs, qrels, docs, spark.createDataFrame([(1,)], "query_id long")).first()
    assert r.relevant == 0            # by id: b is not a
    assert r.ap == 1.0                # by content: b is a copy of a
    assert r.recall_multi_hit == 1.0


def test_resolve_qrels_dedups_and_restricts(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "doc_id string, content string")
    qrels = spark.createDataFrame([(1, "a"), (1, "a"), (1, "zz"), (2, "b")], "query_id long, doc_id string")
    got = sorted(map(tuple, evaluate.resolve_qrels(qrels, docs).collect()))
    assert got == [(1, "a"), (2, "b")]

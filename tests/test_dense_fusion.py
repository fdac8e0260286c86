"""Exact cosine top-k, vector edge cases, fusion golden, HyDE mean."""

import math

from pyspark.sql import functions as F

from quarry.operators import dense
from quarry.operators.dense import dense_search
from quarry.operators.fusion import rrf
from quarry.operators.vectors import hyde_mean


def test_cosine_edges(spark):
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, [0.6, 0.8])],
        "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(10, [2.0, 0.0], 10), (11, [0.0, 0.0], 10)],
                               "query_id long, embedding array<float>, top_k int")
    out = dense_search(docs, qs).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in out] == [
        (10, 1, 1.0), (10, 4, 1.0), (10, 6, 0.6), (10, 5, -1.0)]   # copies tie by id; zero/NULL skipped
    assert all(-1.0 <= r.score <= 1.0 and not math.isnan(r.score) for r in out)


def test_cosine_blocks_give_same_result(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)],
                                 "doc_id long, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(q, [float(q), 1.0, float(q % 3)], 3) for q in range(20)],
                               "query_id long, embedding array<float>, top_k int")
    one = sorted(map(tuple, dense_search(docs, qs).collect()))
    many = sorted(map(tuple, dense_search(docs, qs, max_broadcast_bytes=100).collect()))
    chunked = sorted(map(tuple, dense_search(docs, qs, query_chunk=3).collect()))
    assert one == many == chunked and len(one) == 60


def test_tiles_give_the_exact_result_without_broadcast(spark):
    docs = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5), 1.0] + [0.5] * (i % 2)) for i in range(300)]
                                 + [(900, None), (901, [0.0, 0.0, 0.0]), (902, [float("nan"), 1.0, 0.0])],
                                 "doc_id long, embedding array<double>").repartition(4, "doc_id")
    qs = docs.select(F.col("doc_id").alias("query_id"), "embedding", F.lit(4).alias("top_k"))
    d, q = dense.units(docs, "doc_id"), dense.units(qs, "query_id")
    tiled = dense.tiled_candidates(d, q, 4, tile_bytes=1500, block_bytes=900, query_chunk=7)
    per_tile = tiled.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert 4 < per_tile <= 4 * 6                      # k rows per tile and query
    plan = dense_search(docs, qs, max_broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInPandas" not in plan
    want = sorted(map(tuple, dense_search(docs, qs).collect()))
    assert sorted(map(tuple, dense_search(docs, qs, max_broadcast_bytes=0).collect())) == want
    from quarry.plans.topk import ranked
    got = ranked(tiled, qs.select("query_id", "top_k"), 4).select("query_id", "rank", "doc_id", F.round("score", 6))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 1200


def test_stored_unit_vectors_are_taken_as_they_are(spark):
    docs = spark.createDataFrame([(1, [9.0, 9.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, [1.0, 1.0], None)],
                                 "doc_id long, embedding array<double>, unit array<double>")
    qs = spark.createDataFrame([(7, [3.0, 0.0], 5)], "query_id long, embedding array<double>, top_k int")
    assert [(r.doc_id, r.score) for r in dense_search(docs, qs).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_rrf_golden(spark):
    q = spark.createDataFrame([(1, 10)], "query_id long, top_k int")
    leg1 = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "C")], "query_id long, rank int, doc_id string")
    leg2 = spark.createDataFrame([(1, 1, "B"), (1, 2, "D")], "query_id long, rank int, doc_id string")
    got = {r.doc_id: r.score for r in rrf([leg1, leg2], q).collect()}
    assert got == {"B": 0.991935, "A": 0.5, "D": 0.491935, "C": 0.484127}


def test_hyde_mean(spark):
    hv = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 5.0])],
                               "query_id long, embedding array<float>")
    got = {r.query_id: r.embedding for r in hyde_mean(hv).collect()}
    assert got == {1: [2.0, 3.0], 2: [5.0, 5.0]}


def test_best_passes_over_what_cannot_reach_the_kth():
    import numpy as np

    from quarry.operators.dense import Best, as_ids
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(6, 4000)), 1) + rng.normal(size=(6, 4000)) * 1e-11   # many near ties
    order, got = rng.permutation(4000), Best(6, 7)
    for at in range(0, 4000, 500):
        part = np.sort(order[at:at + 500])
        got.add(scores[:, part], as_ids(part.tolist()))
    for i in range(6):
        want = sorted(range(4000), key=lambda j: (-round(scores[i, j], 9), j))[:7]
        assert got.ids[i].tolist() == want and got.scores[i].tolist() == scores[i, want].tolist()


def test_no_query_with_a_direction(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<float>")
    qs = spark.createDataFrame([(1, [0.0, 0.0], 3), (2, None, 3)], "query_id long, embedding array<float>, top_k int")
    for most in (1 << 20, 0):
        assert dense_search(docs, qs, max_broadcast_bytes=most).collect() == []


def test_queries_meet_only_leaves_that_can_reach(monkeypatch):
    """Near vectors: exact results from a small part of all pairs, copies and near ties included."""
    import numpy as np

    pairs, meet = [], dense._Walk.meet
    monkeypatch.setattr(dense._Walk, "meet", lambda self, leaf, who: (
        pairs.append(len(who) * int(np.diff(self.leaves.starts)[leaf])), meet(self, leaf, who))[1])
    rng = np.random.default_rng(11)
    rows = np.abs(rng.normal(size=(6000, 4)))
    rows[2000:2400] = rows[7]                                      # copies
    rows[3000:3300] = rows[9] * (1 + rng.normal(size=(300, 1)) * 1e-13)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries = np.concatenate([rows[:300], np.abs(rng.normal(size=(100, 4)))])
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    who, place, _ = dense.Leaves(rows, 10, 64).best(queries)
    scores = np.round(queries @ rows.T, 9)
    for i in range(len(queries)):
        assert place[who == i].tolist() == np.lexsort((np.arange(6000), -scores[i]))[:10].tolist()
    assert sum(pairs) < 0.35 * scores.size


def test_vectors_without_near_ones_are_all_met(monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "CANDIDATES", 500)
    rng = np.random.default_rng(12)
    rows, queries = rng.normal(size=(700, 40)), rng.normal(size=(50, 40))
    for k in (1, 9, 900):
        who, place, score = dense.Leaves(rows, k, 16).best(queries)
        scores = queries @ rows.T
        for i in range(50):
            want = np.lexsort((np.arange(700), -np.round(scores[i], 9)))[:k]
            assert place[who == i].tolist() == want.tolist()
            np.testing.assert_allclose(score[who == i], scores[i][want], atol=1e-12)


def test_many_answers_go_to_tiles_and_vectors_are_computed_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encoded(i):
        runs.add(1)
        return [float(i % 7) - 3, float(i % 5), 1.0] if i % 11 else None
    docs = spark.range(240).select(F.concat(F.lit("d"), "id").alias("doc_id"), encoded("id").alias("embedding"))
    docs = docs.unionByName(spark.createDataFrame([("d7", [4.0, 2.0, 1.0]), (None, [1.0, 2.0, 1.0])],
                                                     "doc_id string, embedding array<double>"))
    qs = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(0.5)).alias("embedding"),
                                F.lit(3).alias("top_k")).withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, dense_search(docs, qs).collect()))
    before = runs.value
    monkeypatch.setattr(dense, "BROADCAST_CANDIDATES", 100)
    out = dense_search(docs, qs)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == want and len(want) == 180
    assert runs.value - before == 240

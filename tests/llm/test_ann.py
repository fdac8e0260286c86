"""Operator 8: recall and exact scores against brute force, awkward vectors."""

import numpy as np

from quarry.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, queries, k):
    out = {}
    for q, v in rows.items():
        if q in queries:
            near = sorted((-(np.array(v, np.float32).astype(float) * np.array(w, np.float32)).sum(), i)
                          for i, w in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def run(spark, df, k=A.K, **options):
    got = {}
    for r in A.nearest(df, df.filter("vec_id % 20 = 0"), k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 64)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    want = brute(rows, {i for i in rows if i % 20 == 0}, A.K)
    got = run(spark, df, leaf_rows=30)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) == A.K
        exact = [(np.array(rows[q]) * np.array(rows[i])).sum() for i, _ in near]
        np.testing.assert_allclose([s for _, s in near], exact, rtol=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_copies_and_unusable(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.5, 0.25], 1.0) for i in range(0, 300)]
    rows += [(i, rng.normal(size=3).tolist(), 1.0) for i in range(300, 360)]
    bad = [(1000, None, 1.0), (1020, [0.0, 0.0, 0.0], 1.0), (1040, [1.0, None, 1.0], 1.0), (1060, [1.0, 2.0], 1.0),
           (1080, [float("nan"), 1.0, 1.0], 1.0), (1100, [float("inf"), 1.0, 1.0], 1.0), (None, [9.0, 9.0, 9.0], 1.0),
           (1120, [], 1.0)]
    df = spark.createDataFrame(rows + bad + rows[:2], SCHEMA).repartition(3)
    got = run(spark, df, target=1.0)
    want = brute({i: v for i, v, _ in rows}, set(range(0, 360, 20)), A.K)
    assert got == want


def test_short_lists_are_widened(spark, monkeypatch):
    """Visits too few for k rows: each query goes on until it has them."""
    monkeypatch.setattr(A, "calibrated_visits", lambda *_: 1)
    monkeypatch.setattr(A, "LEAF_SAMPLE", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), 1.0) for i in range(200)]
    got = run(spark, spark.createDataFrame(rows, SCHEMA), leaf_rows=3)
    assert len(got) == 10 and all(len(near) == A.K for near in got.values())
    got = run(spark, spark.createDataFrame(rows[:15], SCHEMA), leaf_rows=3)
    assert {q: len(near) for q, near in got.items()} == {0: 14}


def test_calibration_leaves_the_query_out():
    sample = np.arange(400, dtype=float).reshape(100, 4) % 37
    tree = A.Tree(sample, 5)
    q = sample[:3]
    assert A.calibrated_visits(tree, q, [np.repeat(v[None], 4, 0) for v in q]) == 1    # only itself and copies


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0.0), (1, [2.0, 1.0], 0.0), (20, [1.0, 1.0], 0.0)], SCHEMA)
    assert run(spark, df) == {0: [(1, 4.0), (20, 3.0)], 20: [(0, 3.0), (1, 3.0)]}
    assert run(spark, df.filter("vec_id = 0")) == {} and run(spark, df.limit(0)) == {}


def test_visits_are_no_rows(spark, monkeypatch):
    """What is written grows with vectors and results, not with queries times visits."""
    written, kept = {}, A.pinned

    def recorded(df, name, *args):
        out = kept(df, name, *args)
        written[name] = max(written.get(name, 0), out.count())
        return out
    monkeypatch.setattr(A, "pinned", recorded)
    monkeypatch.setattr(A, "calibrated_visits", lambda *_: 60)
    monkeypatch.setattr(A, "LEAF_SAMPLE", 2)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist(), 1.0) for i in range(400)]
    got = run(spark, spark.createDataFrame(rows, SCHEMA), leaf_rows=3)
    assert len(got) == 20 and all(len(near) == A.K for near in got.values())
    assert max(written.values()) <= max(400, 20 * (A.K + 1)), written


def test_tiles_hold_every_leaf_once():
    counts = np.array([3, 0, 25, 4, 4, 4, 10, 1])
    t = A.Tiles(counts, 10)
    assert t.parts.tolist() == [1, 0, 3, 1, 1, 1, 1, 1]
    assert t.tile[counts > 0].tolist() == [0, 1, 4, 4, 5, 6, 7] and t.n == 8
    assert t.starts == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert sorted(t.slots(np.arange(8)).tolist()) == list(range(9)) and t.slots(np.array([1])).tolist() == []
    assert t.slots(np.array([4, 2])).tolist() == [5, 1, 2, 3]
    assert (t.pos == np.where(t.parts > 0, t.slot - np.array(t.starts)[t.tile], 0)).all()


def test_tile_gives_each_query_its_best(monkeypatch):
    """Ties to smaller ids, bounds kept, in any pieces."""
    for size in ("QUERY_CHUNK", "ROW_CHUNK", "CANDIDATES", "DEAL_BYTES"):
        monkeypatch.setattr(A, size, 40)
    rng = np.random.default_rng(8)
    rows = rng.integers(-2, 3, (300, 3)).astype(np.float32)
    ids, starts = rng.permutation(300), np.array([0, 120, 120, 125, 300])
    queries = rng.integers(-2, 3, (90, 3)).astype(float)
    met, bounds = rng.random((90, 4)) < 0.6, np.where(rng.random(90) < 0.5, 4.0, -np.inf)
    who, near, scores = A.tile_best(queries, met, bounds, rows, ids, starts, 5)
    leaf = np.repeat(np.arange(4), np.diff(starts))
    for q in range(90):
        every = sorted((-s, i) for s, i, p in zip((rows * queries[q]).sum(1).tolist(), ids.tolist(), leaf, strict=True)
                       if met[q, p] and s >= bounds[q])
        assert [(-s, i) for s, i in zip(scores[who == q].tolist(), near[who == q].tolist(), strict=True)] == every[:5]

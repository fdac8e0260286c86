"""Plan-shape helpers: salted join, bounded broadcast, top-k."""

from pyspark.sql import functions as F

from quarry.operators.passages import containing_documents
from quarry.plans.joins import is_bounded, lookup_join, salted_hot_join, skew_join
from quarry.plans.topk import top_k_per_group


def test_skew_join_equals_plain_join(spark):
    # key 0 holds half of all rows: it is hot and split
    big = spark.createDataFrame([(i, 0 if i % 2 == 0 else i % 97) for i in range(4000)], "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 97, 2)], "k long, v string")
    want = sorted(map(tuple, big.join(small, "k").collect()))
    got = sorted(map(tuple, skew_join(big, small, "k", max_hot=10, salt_rows=50).select("k", "id", "v").collect()))
    assert got == want
    left = sorted(map(tuple, skew_join(big, small, "k", how="left", max_hot=10, salt_rows=50).select("k", "id", "v").collect()))
    assert left == sorted(map(tuple, big.join(small, "k", "left").select("k", "id", "v").collect()))


def test_lookup_join_falls_back_beyond_bound(spark):
    big = spark.createDataFrame([(i, i % 5) for i in range(100)], "id long, k long")
    small = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    assert is_bounded(small, 5) and not is_bounded(small, 4)
    a = sorted(map(tuple, lookup_join(big, small, "k", max_broadcast_rows=100).select("id", "v").collect()))
    b = sorted(map(tuple, lookup_join(big, small, "k", max_broadcast_rows=2).select("id", "v").collect()))
    assert a == b and len(a) == 100


def test_topk_partial_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    out = top_k_per_group(df, ["g"], [F.col("v").desc()], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.g, r.v) for r in out.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_containing_documents_unbounded_path(spark):
    line = "a repeated licence line that appears everywhere in the corpus"
    docs = spark.createDataFrame([(i, f"doc {i} {line} end") for i in range(40)] + [(99, "nothing here")],
                                 "doc_id long, content string")
    ps = spark.createDataFrame([(1, "repeated licence line that appears"), (2, "nothing here at all")],
                               "query_id long, passage string")
    small = sorted(map(tuple, containing_documents(docs, ps).collect()))
    big = sorted(map(tuple, containing_documents(docs, ps, max_broadcast_rows=0).collect()))
    assert small == big == [(1, i) for i in range(40)]


def test_salted_hot_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, 0 if i % 3 else i % 11) for i in range(3000)], "id long, k long")
    other = spark.createDataFrame([(k % 11 if k % 5 else 0, k) for k in range(200)], "k long, q long")
    want = sorted(map(tuple, big.join(other, "k").select("k", "id", "q").collect()))
    got = sorted(map(tuple, salted_hot_join(big, other, "k", ["id"], salts=7, max_hot=5)
                     .select("k", "id", "q").collect()))
    assert got == want


def test_skew_join_left_keeps_rows_without_a_key(spark):
    big = spark.createDataFrame([(i, None if i % 3 else i % 7) for i in range(900)], "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string")
    got = skew_join(big, small, "k", how="left", max_hot=4, salt_rows=10).select("id", "k", "v").collect()
    assert sorted(got, key=str) == sorted(big.join(small, "k", "left").select("id", "k", "v").collect(), key=str)


def test_groups_after_a_salted_join_are_whole(spark):
    """The join's output is grouped by the key that the input was dealt by."""
    big = spark.createDataFrame([(i % 40, i % 3 and i % 11) for i in range(4000)], "d long, k long").repartition(5, "d")
    small = spark.createDataFrame([(k, 1) for k in range(11)], "k long, v int")
    out = skew_join(big, small, "k", max_hot=5, salt_rows=10).groupBy("d").agg(F.sum("v").alias("n")).collect()
    assert sorted(map(tuple, out)) == [(d, 100) for d in range(40)]

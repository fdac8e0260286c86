"""Operator 6: capacities against brute force, laws on awkward tables."""

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import sharding as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 4))
def test_smallest_capacity_and_floor(sizes, shards):
    n = len(sizes)
    splits = [(0, *cut, n) for cut in itertools.combinations_with_replacement(range(n + 1), shards - 1)]
    loads = [[sum(sizes[a:b]) for a, b in itertools.pairwise(s)] for s in splits]
    best = min(max(x) for x in loads)
    out = S.contiguous_shards(np.array(sizes), shards)
    got = [sum(s for s, k in zip(sizes, out, strict=True) if k == i) for i in range(shards)]
    assert S.smallest_capacity(np.array(sizes), shards) == best == max(got)
    assert min(got) == max(min(x) for x in loads if max(x) == best)
    assert list(out) == sorted(out)


def _laws(df, rows, shards):
    got = df.collect()
    assert len(got) == len(rows)
    by_shard, by_text = {}, {}
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        assert 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    return got


def test_laws_with_hot_group(spark):
    rows = [(i, "hot text " * 20) for i in range(300)] + [(1000 + i, f"t{i}" * (i % 17)) for i in range(600)]
    rows += [(None, None), (None, "x"), (7, "hot text " * 20), (2000, "é🎉" * 5), (2000, "é🎉" * 5), (2001, "")]
    df = spark.createDataFrame([(i, t, 3, "s") for i, t in rows], "doc_id long, text string, shard int, salt string")
    got = _laws(S.shard_documents(df.repartition(5), 8), rows, 8)
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    hot = max(load.values())
    rest = [v for v in load.values() if v != hot]
    assert hot == 301 * (180 + 16) and len(rest) == 7 and max(rest) < 1.1 * min(rest)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    _laws(S.shard_documents(df, 40), [(1, "a"), (2, "b")], 40)
    assert S.shard_documents(df.limit(0)).count() == 0


def test_group_of_many_small_rows_is_set_apart(spark):
    rows = [(i, None if i % 2 else "") for i in range(300)] + [(1000 + i, f"text {i} " * 40) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = _laws(S.shard_documents(df.repartition(5), 8), rows, 8)
    load = {}
    for r in got:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values())
    hashed = df.select("doc_id", F.lit(16).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    hashed = hashed.withColumn("cell", F.shiftrightunsigned("h", 64 - S.CELL_BITS).cast("int"))
    cells = {r["cell"]: (1, r["n"]) for r in hashed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert [(r["n"]) for r in S.heavy_groups(hashed, cells, 8)] == [300]


def test_capacity_is_that_of_groups_where_cells_collide(spark):
    for seed, bits in [(1, 2), (2, 3), (3, 18)]:
        rows = [(i, f"{seed} {i} " + "x" * (i * 37 % 211)) for i in range(400)] + [(900 + i, f"{seed} {i % 9} twice") for i in range(27)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = _laws(S.shard_documents(df, 7, bits), rows, 7)
        load, shard = {}, {r["doc_id"]: r["shard"] for r in got}
        for r in got:
            load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        groups = (df.withColumn("h", F.xxhash64("text")).groupBy("h").agg(
            F.sum(F.octet_length("text") + 16).alias("bytes"), F.first("doc_id").alias("doc_id")).collect())
        groups.sort(key=lambda r: r["h"] % (1 << 64))
        assert max(load.values()) == S.smallest_capacity(np.array([r["bytes"] for r in groups]), 7)
        assert [shard[r["doc_id"]] for r in groups] == sorted(shard[r["doc_id"]] for r in groups)

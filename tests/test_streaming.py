"""The streaming request path gives the batch answer."""

import os

from quarry.config import SearchConfig
from quarry.operators import models
from quarry.plans.search import search
from quarry.session import shared_dir
from quarry.streaming.search_stream import read_query_stream, start_search_stream


def test_stream_matches_batch(spark):
    docs = spark.createDataFrame([(1, "solar robot arm"), (2, "robot robot vision system"),
                                  (3, "banana leaf disease"), (4, "leaf robot")],
                                 "doc_id long, content string")
    enc = models.hash_encoder()
    vecs = models.embed_documents(docs, enc).cache()
    qdir = shared_dir(spark, "test_stream_in")
    out = shared_dir(spark, "test_stream_out")
    q1 = spark.createDataFrame([(1, "robot", 2), (2, "leaf", 3)], "query_id long, query string, top_k int")
    q1.write.parquet(os.path.join(qdir, "part1"))
    cfg = SearchConfig(use_bm25=True)
    stream = read_query_stream(spark, os.path.join(qdir, "*"))
    h = start_search_stream(stream, docs, vecs, cfg, enc, out, available_now=True)
    h.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).drop("epoch").collect())
    want = sorted(tuple(r) for r in search(docs, q1, cfg, enc, doc_vectors=vecs).collect())
    assert got == want and len(got) == 5

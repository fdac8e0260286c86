"""Reciprocal-rank fusion.

score(d) = (RRF_K / legs) * sum over legs holding d of 1 / (RRF_K + rank0),
rank0 being the 0-based rank in that leg, so being first in every leg scores
1.0. The legs are unioned and summed by (query_id, doc_id): a partial
aggregate over at most k rows per leg and query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import RRF_K
from quarry.plans.topk import OUTPUT_PLACES, ranked


def rrf(legs: Sequence[DataFrame], queries: DataFrame, k: int = RRF_K,
        k_max: int | None = None) -> DataFrame:
    """legs: each (query_id, rank, doc_id, ...), rank 1-based;
    queries: (query_id, top_k). Returns (query_id, rank, doc_id, score)."""
    n = len(legs)
    parts = [leg.select("query_id", "doc_id", (F.col("rank") - 1).alias("rank0")) for leg in legs]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    summed = (u.groupBy("query_id", "doc_id")
              .agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank0"))).alias("s"))
              .select("query_id", "doc_id", (F.col("s") * (float(k) / n)).alias("score")))
    out = ranked(summed, queries.select("query_id", "top_k"), k_max)
    return out.select("query_id", "rank", "doc_id", F.round("score", OUTPUT_PLACES).alias("score"))

"""Per-group top-k.

``row_number() <= k_max`` with a *literal* bound makes Catalyst plan a
partial ``WindowGroupLimit`` before the shuffle: each map task sends at most
k_max rows per group, so a query that matches a third of the corpus still
moves only k_max rows per task. The literal is the largest requested k,
read from the data, never a cap; the per-row ``top_k`` is applied after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT_TOP_K

# Fixed value: ranking is on the score rounded to 9 places, ties by id, so
# that sums taken in a different order still give the same ranking.
SCORE_PLACES = 9
OUTPUT_PLACES = 6


def ranking_order(score: str = "score", tie: str = "doc_id") -> list[Column]:
    return [F.round(F.col(score), SCORE_PLACES).desc(), F.col(tie).asc()]


def requested_k(col: str = "top_k") -> Column:
    """A query's k; without one, the default."""
    return F.coalesce(F.col(col), F.lit(DEFAULT_TOP_K))


def max_k(queries: DataFrame, col: str = "top_k") -> int:
    """Largest requested k (one tiny aggregate over the queries table)."""
    v = queries.agg(F.max(requested_k(col))).first()[0]
    return int(v) if v is not None else 0


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    k_max: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(int(k_max)))


def ranked(df: DataFrame, queries: DataFrame, k_max: int | None = None,
           score: str = "score", tie: str = "doc_id", group: str = "query_id",
           top_k_col: str = "top_k") -> DataFrame:
    """Top ``top_k`` rows per query (top_k read from ``queries``), ranked 1..k."""
    if k_max is None:
        k_max = max_k(queries, top_k_col)
    limited = top_k_per_group(df, [group], ranking_order(score, tie), max(k_max, 1))
    ks = queries.select(group, requested_k(top_k_col).alias(top_k_col))
    return (limited.join(ks, group)
            .filter(F.col("rank") <= F.col(top_k_col))
            .drop(top_k_col))

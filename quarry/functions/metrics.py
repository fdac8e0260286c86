"""Retrieval-metric formulas as Column expressions. Every ratio that can be
undefined uses try_divide, so it is NULL instead of an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def precision(relevant, retrieved) -> Column:
    """O55."""
    return F.try_divide(_c(relevant).cast("double"), _c(retrieved))


def recall(relevant, ground_truth) -> Column:
    """O56."""
    return F.try_divide(_c(relevant).cast("double"), _c(ground_truth))


def fallout(retrieved, relevant, corpus, ground_truth) -> Column:
    """Irrelevant retrieved over irrelevant in the corpus."""
    return F.try_divide((_c(retrieved) - _c(relevant)).cast("double"),
                        _c(corpus) - _c(ground_truth))


def f_beta(p, r, beta: float) -> Column:
    """NULL when p = r = 0 or either is NULL."""
    b2 = float(beta) * float(beta)
    p, r = _c(p), _c(r)
    return F.try_divide((1.0 + b2) * p * r, b2 * p + r)


def position_discount(rank) -> Column:
    """1 / log2(rank + 1) for a 1-based rank."""
    return 1.0 / F.log2(_c(rank).cast("double") + 1.0)

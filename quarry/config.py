"""Plain option objects (not data)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bm25Params:
    # The BM25L variant and defaults of the reference's
    # in-memory document store.
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5

    @property
    def absent_tf(self) -> float:
        """tf of a term that does not occur (c = 0): BM25L adds delta anyway."""
        return (1.0 + self.k1) * self.delta / (self.k1 + self.delta)


# Fixed value: reciprocal-rank-fusion constant on 0-based ranks.
RRF_K = 61

# Fixed value: result size when a query gives none.
DEFAULT_TOP_K = 10

# Fixed value: the fusion leg of BM25 is never given the request's top_k,
# so it keeps the retriever default.
DEFAULT_BM25_TOP_K = 10


@dataclass(frozen=True)
class SearchConfig:
    """The three switches of a search request."""

    use_hyde: bool = False
    use_bm25: bool = False
    use_evaluator: bool = False
    bm25_top_k: int = DEFAULT_BM25_TOP_K

    @property
    def key(self) -> str:
        return f"{int(self.use_hyde)}{int(self.use_bm25)}{int(self.use_evaluator)}"

"""quarry: batch text retrieval and ranking evaluation as Spark jobs.

A table of queries is ranked against a table of documents in one job
(BM25L, exact cosine, reciprocal-rank fusion, hypothetical-document
query vectors), and the rankings are scored against relevance judgments.
Every public function takes DataFrames and returns DataFrames.
"""

from quarry.config import SearchConfig, Bm25Params

__all__ = ["SearchConfig", "Bm25Params"]

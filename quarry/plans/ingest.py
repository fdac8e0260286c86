"""Ingest: stored pages -> paper CSV -> document table (O02, O04, O01, O09,
O16, O08), the crawl-to-dataset path without the crawling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators import prep
from quarry.sources import files, pages


def ingest_pages(pages_df: DataFrame, csv_path: str) -> DataFrame:
    """Extract papers from ``pages(page_id, url, html)``, write them as CSV at
    ``csv_path`` (skipped when it exists), read them back, drop papers without
    abstract, keep one row per title (the first by abstract, then URL) and
    return ``(doc_id, content)``."""
    papers = pages.extract_pages(pages_df).select("title", "abstract", "webpage_url", "document_url")
    files.write_papers(papers, csv_path)
    spark = pages_df.sparkSession
    back = prep.drop_missing(files.read_papers(spark, csv_path), "abstract")
    first = prep.unique_by(back, ["title"], ["abstract", "webpage_url", "document_url"])
    return prep.to_documents(first)

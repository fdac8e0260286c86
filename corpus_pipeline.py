"""Corpus pipeline: documents -> packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; its result is written as Parquet and read again. All stages but
the last return the columns of ``documents``. Every stage takes empty tables (and
returns none) and keeps extra columns, whatever their names, until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import pinned, read_table, unused
from quarry.llm.decontaminate import remove_contaminated
from quarry.llm.jaccard_join import one_of_each_class
from quarry.llm.language import keep_identified
from quarry.llm.line_dedup import remove_repeated
from quarry.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go. Null or empty texts are judged by label and
    source; a null label or source is a value of its own; ties go to a language, so the
    document stays; repeated rows share one fate; without any label all stay."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go from the texts, and documents of which no line is left. Null
    and empty texts stay; of equal chunks the one with the smallest (doc_id, line) stays,
    null ids first; rows that share id and text keep or lose a chunk together; ``n_chars``
    follows the text where that changed (a null one too), other columns stay as they are."""
    lines, removed = unused(docs, "__lines"), unused(docs, "__removed")
    out = remove_repeated(docs, lines, removed).filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    changed = F.col(removed) > 0
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Rows that
    share an id are one document, so one of them stays (of repeated rows too); null ids
    and texts without words are near nothing and stay."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and
    stay; null or empty items are in no document; repeated rows share one fate."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence. A null or empty text
    is its end id alone; repeated rows are packed each; ties go in piece order."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", packing)]
# Trigram likelihoods and best-fit packing are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

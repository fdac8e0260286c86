"""Preparation operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import WHITESPACE, counted, explode_values
from quarry.plans.joins import bounded_broadcast

# Content made only of whitespace (Python's notion) is blank.
WHITESPACE_ONLY = WHITESPACE


def to_documents(papers: DataFrame) -> DataFrame:
    """Title -> doc_id, abstract -> content."""
    return papers.select(F.col("title").alias("doc_id"), F.col("abstract").alias("content"))


def drop_missing(df: DataFrame, col: str = "content") -> DataFrame:
    """O09."""
    return df.filter(F.col(col).isNotNull())


def keep_in(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose ``col`` is in a literal list, or in a one-column
    DataFrame (a semi join, broadcast only when provably small)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(bounded_broadcast(v), col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def null_to_empty(col: str = "content"):
    """O11."""
    return F.coalesce(F.col(col), F.lit(""))


def select_method(df: DataFrame, method: str, col: str = "method") -> DataFrame:
    """One index by name (partition pruning on ``method``); unknown -> error."""
    picked = df.filter(F.col(col) == method)
    if picked.limit(1).count() == 0:
        raise ValueError(f"unknown method {method!r}")
    return picked


def unique_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending).

    A min over a struct is a partial aggregate: copies of one key collapse
    map-side, so a key holding a third of all rows is not gathered in one task."""
    key = list(key)
    rest = [c for c in df.columns if c not in key and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_first")
    return df.groupBy(*key).agg(packed).select(*key, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def dedup_by_content(documents: DataFrame, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """O09 + O16 on the text: one row per distinct content, the first by
    ``order``. Grouped by the SHA-256 of the text (fixed-size keys, map-side
    combine), so whole texts are neither hashed nor compared in the
    aggregate; copies collapse before the shuffle."""
    keyed = drop_missing(documents).withColumn("_ck", F.sha2("content", 256))
    first = unique_by(keyed, ["_ck"], list(order))
    return first.select(*documents.columns)


def ids_are_unique(documents: DataFrame) -> bool:
    """True when no ``doc_id`` stands in two rows (one narrow count)."""
    return documents.groupBy("doc_id").count().filter("count > 1").isEmpty()


def count_values(documents: DataFrame, values, value: str, n: str) -> DataFrame:
    """(doc_id, value, n): how often each element of the array ``values`` occurs.

    A document is counted inside its row; only a table in which an id stands in
    several rows is grouped by (doc_id, value) afterwards."""
    rows = explode_values(documents, counted(values), "_v", keep=["doc_id"]).select(
        "doc_id", F.col("_v.value").alias(value), F.col("_v.n").alias(n))
    if ids_are_unique(documents):
        return rows
    return rows.groupBy("doc_id", value).agg(F.sum(n).alias(n))


def validate_documents(documents: DataFrame, embeddings: DataFrame | None = None,
                       dim=None) -> DataFrame:
    """(rule, n) counts of rule violations, zeros included.

    rules: null_id, null_or_blank_content, duplicate_id, wrong_length_vector.
    ``dim`` defaults to the most common vector length."""
    d = documents.agg(
        F.sum(F.when(F.col("doc_id").isNull(), 1).otherwise(0)).alias("null_id"),
        F.sum(F.when(F.col("content").isNull()
                     | (F.regexp_replace("content", WHITESPACE_ONLY, "") == ""), 1).otherwise(0))
         .alias("null_or_blank_content"))
    dup = (documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
           .filter(F.col("count") > 1).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_id")))
    # One pass over the texts gives both counts, one row each.
    both = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("n"))
                               for r in ("null_id", "null_or_blank_content")])).alias("r")
    out = d.select(both).select("r.rule", "r.n").unionByName(
        dup.select(F.lit("duplicate_id").alias("rule"), F.col("duplicate_id").cast("long").alias("n")))
    if embeddings is not None:
        if dim is None:
            dim = (embeddings.groupBy(F.size("embedding").alias("len")).count()
                   .orderBy(F.col("count").desc(), F.col("len")).limit(1).select("len").scalar())
        elif isinstance(dim, int):
            dim = F.lit(dim)
        bad = embeddings.agg(F.sum(F.when(F.col("embedding").isNull() | (F.size("embedding") != dim), 1)
                                   .otherwise(0)).cast("long").alias("n"))
        out = out.unionByName(bad.select(F.lit("wrong_length_vector").alias("rule"), "n"))
    return out.fillna(0, ["n"])

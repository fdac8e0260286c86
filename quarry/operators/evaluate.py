"""Ranking evaluation.

Inputs
  runs:      (method, query_id, rank, doc_id[, similarity])   rank is 1-based
  qrels:     (query_id, doc_id)                               binary relevance
  documents: (doc_id, content)
  queries:   (query_id, ...)                                  every query gets a row

Matching follows the reference's split: precision, recall, F-beta and NDCG
match by document id; average precision and multi-hit recall match by
*content* (a copy of a relevant text counts). Content is compared by its
SHA-256, so whole texts are never shuffled.

All groupings are by (method, query_id) or finer, over runs that are at most
k long per query, or are partial aggregates; nothing gathers a whole query's
judgments into one row. The ideal DCG of n judged documents is summed in
chunks of rows (``ideal_dcg``), so a query with millions of judgments is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.plans.joins import join_small_to_big
from quarry.session import shared_dir

IDCG_CHUNK = 4096
METRIC_COLUMNS = ["precision", "recall", "fallout", "f1", "f2", "ndcg", "ap",
                  "recall_multi_hit", "avg_similarity"]


def content_keys(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_key"))


def title_judgments(lists: DataFrame, documents: DataFrame) -> DataFrame:
    """O22 from given lists: (query_id, titles) -> (query_id, doc_id), the listed
    titles that are loaded documents. Repeated and unknown titles, and queries
    without a list, add nothing."""
    named = lists.select("query_id", F.explode_outer("titles").alias("doc_id")).filter("doc_id IS NOT NULL")
    return resolve_qrels(named, documents)


def resolve_qrels(qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """Judgments restricted to loaded documents, one row per pair.

    Judgments are few next to the corpus: pinned, then broadcast into the
    scan of document ids when bounded; the distinct is over that small
    result (a repeated document id must not repeat a judgment)."""
    shared_dir(qrels.sparkSession)
    pairs = qrels.select("query_id", "doc_id").distinct().checkpoint()
    return (join_small_to_big(pairs, documents.select("doc_id"), "doc_id")
            .select("query_id", "doc_id").distinct())


def mark_relevant(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each retrieved row with ``relevant`` (1/0) by id."""
    truth = qrels.select("query_id", "doc_id", F.lit(1).alias("relevant"))
    return (runs.join(truth, ["query_id", "doc_id"], "left")
            .withColumn("relevant", F.coalesce("relevant", F.lit(0))))


def ideal_dcg(counts: DataFrame, n_col: str = "n_truth", chunk: int = IDCG_CHUNK) -> DataFrame:
    """(query_id, idcg) with idcg = sum_{i=1..n} 1/log2(i+1).

    Each query is cut into ceil(n/chunk) rows; each row sums its own range;
    the partial sums are added by a (partial) aggregate."""
    n = F.col(n_col)
    chunks = counts.filter(n > 0).select(
        "query_id", n.alias("n"),
        F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("long"))).alias("c"))
    lo = F.col("c") * chunk + 1
    hi = F.least(F.col("n"), (F.col("c") + 1) * chunk)
    part = F.aggregate(F.sequence(lo, hi), F.lit(0.0).cast("double"),
                       lambda acc, i: acc + 1.0 / F.log2(i.cast("double") + 1.0))
    return chunks.select("query_id", part.alias("p")).groupBy("query_id").agg(F.sum("p").alias("idcg"))


def _methods_x_queries(runs: DataFrame, queries: DataFrame, methods: Sequence[str] | None) -> DataFrame:
    """Every (method, query) pair, so a query or a whole method with no result
    keeps its rows. The caller names the methods; without names they are those
    of the runs (a scalar subquery, one array of names)."""
    names = (F.array(*[F.lit(m) for m in methods]) if methods is not None
             else runs.agg(F.array_sort(F.collect_set("method"))).scalar())
    return queries.select("query_id", F.explode(names).alias("method"))


def metrics_per_query(runs: DataFrame, qrels: DataFrame, documents: DataFrame,
                      queries: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """O70 (per query): one row per (method, query_id) with counts and metrics,
    for ``methods`` (default: the methods that have a result)."""
    # Runs and judgments are each read several times below; they are small
    # next to what produced them, so they are written once to the shared
    # checkpoint folder rather than recomputed per use.
    shared_dir(runs.sparkSession)
    runs = runs.checkpoint()
    truth = resolve_qrels(qrels, documents).checkpoint()
    # Content keys only for documents that were retrieved or judged: a small
    # id set, broadcast into the one scan of the texts when bounded.
    needed = runs.select("doc_id").unionByName(truth.select("doc_id")).distinct().checkpoint()
    keys = content_keys(join_small_to_big(needed, documents, "doc_id", "left_semi")).checkpoint()
    n_docs = documents.select(F.count(F.lit(1))).scalar()

    truth_counts = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    idcg = ideal_dcg(truth_counts)

    # Per retrieved row: relevance by id and by content.
    truth_keys = truth.join(keys, "doc_id").select("query_id", "content_key").distinct()
    marked = (mark_relevant(runs, truth)
              .join(keys, "doc_id", "left")
              .join(truth_keys.withColumn("rel_content", F.lit(1)), ["query_id", "content_key"], "left")
              .withColumn("rel_content", F.coalesce("rel_content", F.lit(0))))
    if "similarity" not in runs.columns:
        marked = marked.withColumn("similarity", F.lit(None).cast("double"))

    # Running count of content hits down the ranking (run length <= k).
    w = (Window.partitionBy("method", "query_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("hits", F.sum("rel_content").over(w))

    per = marked.groupBy("method", "query_id").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.sum("relevant").alias("relevant"),
        F.sum(F.col("relevant") * M.position_discount("rank")).alias("dcg"),
        F.sum("rel_content").alias("content_hits"),
        F.sum(F.when(F.col("rel_content") == 1, F.col("hits") / F.col("rank"))).alias("ap_num"),
        F.avg("similarity").alias("avg_similarity"),
    )

    # Distinct retrieved contents INTERSECT distinct true contents.
    got = marked.select("method", "query_id", "content_key").distinct()
    want = truth_keys.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth_contents"))
    inter = (got.join(truth_keys, ["query_id", "content_key"], "left_semi")
             .groupBy("method", "query_id").agg(F.count(F.lit(1)).alias("n_hit_contents")))

    base = (_methods_x_queries(runs, queries, methods)
            .join(per, ["method", "query_id"], "left")
            .join(truth_counts, "query_id", "left")
            .join(idcg, "query_id", "left")
            .join(want, "query_id", "left")
            .join(inter, ["method", "query_id"], "left")
            .fillna(0, ["retrieved", "relevant", "content_hits", "n_truth",
                        "n_truth_contents", "n_hit_contents"])
            .fillna(0.0, ["dcg", "idcg"]))

    p = M.precision("relevant", "retrieved")
    r = M.recall("relevant", "n_truth")
    return base.select(
        "method", "query_id", "retrieved", "relevant",
        F.col("n_truth").alias("ground_truth"),
        n_docs.alias("corpus"),
        p.alias("precision"),
        r.alias("recall"),
        M.fallout("retrieved", "relevant", n_docs, "n_truth").alias("fallout"),
        M.f_beta(p, r, 1).alias("f1"),
        M.f_beta(p, r, 2).alias("f2"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"),
        F.when(F.col("content_hits") > 0, F.col("ap_num") / F.col("content_hits"))
         .otherwise(F.lit(0.0)).alias("ap"),
        F.when((F.col("n_truth_contents") > 0) & (F.col("retrieved") > 0),
               F.col("n_hit_contents") / F.col("n_truth_contents"))
         .otherwise(F.lit(0.0)).alias("recall_multi_hit"),
        "avg_similarity",
    )


def metrics_per_method(per_query: DataFrame) -> DataFrame:
    """Mean of each metric over the queries of a method; NULL metrics
    (undefined ratios) are left out of the mean."""
    return per_query.groupBy("method").agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.avg(c).alias(c) for c in METRIC_COLUMNS])


def round_metrics(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in METRIC_COLUMNS else F.col(c)
                       for c in df.columns])

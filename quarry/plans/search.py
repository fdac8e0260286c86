"""Search composites.

``search`` is the single entry for all eight switch combinations:

  dense leg   cosine top_k of the query vector, or, with HyDE, of the mean
              vector of the query's hypothetical answers embedded with the
              *document* encoder
  BM25 leg    BM25L top ``bm25_top_k`` on the *original* query text
  fusion      RRF of the two legs, truncated to top_k
  evaluator   a pair score of (original query, content) for the returned
              rows only, keyed by (query_id, doc_id): no positional zip

The plan contains only the chosen legs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.operators import models
from quarry.operators.bm25 import bm25_search, bm25_search_index
from quarry.operators.dense import dense_search
from quarry.operators.fusion import rrf
from quarry.operators.prep import null_to_empty
from quarry.operators.vectors import hyde_mean
from quarry.plans.joins import join_small_to_big
from quarry.plans.topk import requested_k
from quarry.session import shared_dir
from quarry.sources.store import live_versions, load_embeddings, read_versions, write_version


@dataclass(frozen=True)
class Method:
    """A way to embed: an encoder, and where the corpus vectors come from: given,
    or stored under the name ``stored_as`` in an embedding ``store``, or computed.

    The encoder is a batch model or a column model (see ``models``), or an encoder
    of whole tables such as the word-vector method (``WordVectorEncoder``)."""

    encoder: object
    doc_vectors: DataFrame | None = None
    store: str | None = None
    stored_as: str | None = None

    def corpus_vectors(self, documents: DataFrame) -> DataFrame:
        if self.doc_vectors is not None:
            return self.doc_vectors
        if self.store is not None:
            return load_embeddings(documents.sparkSession, self.store, self.stored_as)
        return models.embed_documents(documents, self.encoder)


def hyde_query_vectors(queries: DataFrame, hypotheses: DataFrame, make_encoder) -> DataFrame:
    """O68 (front half): (query_id, embedding, top_k) from hypothesis texts
    (query_id, n, text); a query's hypotheses are a corpus of their own."""
    texts = hypotheses.select(F.struct("query_id", "n").alias("doc_id"), "query_id", F.col("text").alias("content"))
    hv = models.embed_documents(texts, make_encoder, keep=["query_id"], within="query_id")
    return hyde_mean(hv.drop("doc_id")).join(queries.select("query_id", "top_k"), "query_id")


def attach_similarity(run: DataFrame, documents: DataFrame, queries: DataFrame,
                      make_scorer) -> DataFrame:
    """O62 + O21 + O39: similarity of each returned row, by key.

    Only returned rows are scored, and a pair that several methods return is
    scored once. Every row of the run stays: one whose document or query is not
    in the tables has a NULL similarity. The pairs (queries x k rows) are pinned
    and, when bounded, broadcast into the document scan: the corpus is never
    shuffled to attach a few texts."""
    shared_dir(run.sparkSession)
    run = run.checkpoint()
    pairs = run.select("query_id", "doc_id").distinct().checkpoint()
    texts = join_small_to_big(pairs, documents.select("doc_id", "content"), "doc_id")
    texts = texts.join(queries.select("query_id", "query"), "query_id")
    scores = texts.select("query_id", "doc_id", models.pair_scores(texts, make_scorer).alias("similarity"))
    return run.join(scores, ["query_id", "doc_id"], "left").select(*run.columns, "similarity")


def search(documents: DataFrame, queries: DataFrame, config: SearchConfig, make_encoder,
           doc_vectors: DataFrame | None = None, hypotheses: DataFrame | None = None,
           make_generator=None, make_scorer=None, store: str | None = None,
           method: str | None = None, bm25_index: str | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score[, similarity]).

    documents: (doc_id, content); queries: (query_id, query, top_k). Any encoder
    serves here (see ``Method``). Document vectors are those given, or those of
    ``method`` in the embedding ``store`` (an unknown method is an error), or are
    computed. ``bm25_index`` is the path of a stored index; without one the BM25
    leg reads the texts."""
    doc_vectors = Method(make_encoder, doc_vectors, store, method).corpus_vectors(documents)
    if config.use_hyde:
        if hypotheses is None:
            if make_generator is None:
                raise ValueError("HyDE needs a hypotheses table or a generator")
            hypotheses = models.generate_hypotheses(queries, make_generator)
        qv = hyde_query_vectors(queries, hypotheses, make_encoder)
    else:
        qv = models.embed_queries(queries, make_encoder)
    run = dense_search(doc_vectors, qv)
    if config.use_bm25:
        bq = queries.withColumn("top_k", F.lit(int(config.bm25_top_k)))
        leg = (bm25_search(documents, bq) if bm25_index is None
               else bm25_search_index(documents.sparkSession, bm25_index, bq))
        run = rrf([run, leg], queries.select("query_id", "top_k"))
    if config.use_evaluator:
        if make_scorer is None:
            raise ValueError("the evaluator needs a scorer")
        run = attach_similarity(run, documents, queries, make_scorer)
    return run


def search_many(documents: DataFrame, queries: DataFrame, configs: dict[str, SearchConfig],
                make_encoder=None, doc_vectors: DataFrame | None = None,
                hypotheses: DataFrame | None = None, make_generator=None, make_scorer=None,
                bm25_method: str | None = None, score_bm25: bool = False,
                methods: dict[str, Method] | None = None, bm25_index: str | None = None) -> DataFrame:
    """Several methods in one job: (method, query_id, rank, doc_id, score[, similarity]).

    One encoder (``make_encoder``) under several ``configs`` gives runs named by
    the config; several ``methods`` give runs named "method config" for each pair.
    Each leg is built once and shared by every run that uses it: a method's
    corpus vectors, its plain and its HyDE dense leg, the generated answers, and
    one BM25L ranking cut to each run's k (ranks are prefix-consistent, ties
    broken by id, so the top-j of a top-k list is the top-j list).
    ``bm25_method`` also emits the BM25L ranking itself as a run at the queries'
    own top_k (scored by the pair scorer when ``score_bm25``)."""
    shared_dir(documents.sparkSession)
    several = methods is not None
    methods = methods if several else {"": Method(make_encoder, doc_vectors)}
    hyde_flags = {c.use_hyde for c in configs.values()}
    if True in hyde_flags and hypotheses is None:
        if make_generator is None:
            raise ValueError("HyDE needs a hypotheses table or a generator")
        hypotheses = models.generate_hypotheses(queries, make_generator)
        if len(methods) > 1:
            hypotheses = hypotheses.checkpoint()
    # Each leg is pinned once (queries x k rows) and then read by every
    # run that uses it, even across separate jobs.
    legs: dict[tuple[str, bool], DataFrame] = {}
    for name, m in methods.items():
        vectors = m.corpus_vectors(documents)
        if len(hyde_flags) > 1 and m.doc_vectors is None and m.store is None:
            vectors = vectors.checkpoint()       # encoded once for the plain and the HyDE leg
        for hyde in hyde_flags:
            qv = (hyde_query_vectors(queries, hypotheses, m.encoder) if hyde
                  else models.embed_queries(queries, m.encoder))
            legs[name, hyde] = dense_search(vectors, qv).checkpoint()

    bm25_ks = {c.bm25_top_k for c in configs.values() if c.use_bm25}
    bm_all = None
    if bm25_ks or bm25_method:
        bq = queries.withColumn("top_k", F.greatest(requested_k(), F.lit(max(bm25_ks or {0}))))
        bm_all = (bm25_search(documents, bq) if bm25_index is None
                  else bm25_search_index(documents.sparkSession, bm25_index, bq)).checkpoint()
    out = []
    if bm25_method:
        run = (bm_all.join(queries.select("query_id", requested_k().alias("top_k")), "query_id")
               .filter(F.col("rank") <= F.col("top_k")).drop("top_k"))
        out.append((bm25_method, run, score_bm25))
    for name in methods:
        for key, cfg in configs.items():
            run = legs[name, cfg.use_hyde]
            if cfg.use_bm25:
                leg = bm_all.filter(F.col("rank") <= cfg.bm25_top_k)
                run = rrf([run, leg], queries.select("query_id", "top_k"))
            out.append((f"{name} {key}" if several else key, run, cfg.use_evaluator))
    result = None
    for name, run, scored in out:
        run = run.withColumns({"method": F.lit(name), "_scored": F.lit(scored)})
        result = run if result is None else result.unionByName(run)
    if not any(scored for _, _, scored in out):
        return result.drop("_scored")
    # All runs are scored in one pass over the corpus.
    result = result.checkpoint()
    done = attach_similarity(result.filter("_scored"), documents, queries, make_scorer)
    return done.unionByName(result.filter("NOT _scored"), allowMissingColumns=True).drop("_scored")


def search_times(documents: DataFrame, queries: DataFrame, configs: dict[str, SearchConfig],
                 methods: dict[str, Method], iterations: int = 20, **parts) -> DataFrame:
    """Mean search time of each method and config: (method, queries, runtime_ms).

    A search is timed as the caller would run it, all queries in one job, its
    rows computed and dropped; ``parts`` go to ``search``."""
    spark, n = documents.sparkSession, queries.count()
    rows = []
    for name, m in methods.items():
        for key, cfg in configs.items():
            began = time.perf_counter()
            for _ in range(iterations):
                run = search(documents, queries, cfg, m.encoder, m.doc_vectors, store=m.store, method=m.stored_as, **parts)
                run.write.format("noop").mode("overwrite").save()
            rows.append((f"{name} {key}", n, (time.perf_counter() - began) * 1000 / iterations))
    return spark.createDataFrame(rows, "method string, queries long, runtime_ms double")


def search_listing(run: DataFrame, documents: DataFrame) -> DataFrame:
    """What the result page shows, as rows: rank, id, content, score and
    the optional similarity (NULL when not scored). Display order is ``rank``."""
    sim = F.col("similarity") if "similarity" in run.columns else F.lit(None).cast("double")
    shared_dir(run.sparkSession)
    run = run.checkpoint()
    texts = join_small_to_big(run.select("doc_id").distinct(), documents.select("doc_id", "content"), "doc_id")
    # Every rank is listed; a document that is not in the table has no content.
    return (run.join(texts, "doc_id", "left")
            .select("query_id", "rank", "doc_id", "content", "score", sim.alias("similarity")))


def get_or_create_embeddings(documents: DataFrame, make_encoder, store_path: str, method: str,
                             force: bool = False) -> DataFrame:
    """Reuse stored vectors, embed only what is missing or changed.

    Keyed by (method, doc_id, sha256(content)): a new or changed text is embedded
    and added to the store as a version, where its newer row wins; nothing else is
    written. ``force`` embeds everything and replaces this method's vectors; other
    methods are never touched. Returns (doc_id, content_hash, embedding, reused)."""
    spark = documents.sparkSession
    keyed = documents.select("doc_id", "content", F.sha2(null_to_empty("content"), 256).alias("content_hash"))
    keys = ["doc_id", "content_hash"]
    todo, replace = keyed, True
    if not force and live_versions(spark, store_path, method):
        replace = False
        stored = read_versions(spark, store_path, method).select(*keys)
        # The few missing keys go to the texts, not the texts to the store.
        missing = _written(keyed.select(*keys).join(stored, keys, "left_anti"), "store_missing")
        todo = join_small_to_big(missing, keyed, keys, "left_semi") if not missing.isEmpty() else None
    added = None
    if todo is not None:
        # Written once: the check for repeated ids and the version both read it.
        fresh = _written(models.embed_documents(todo, make_encoder, keep=["content_hash"], corpus=documents)
                         .select(*keys, "embedding"), "store_fresh")
        repeated = fresh.groupBy("doc_id").count().filter("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"duplicate doc_id in documents: {repeated[0]['doc_id']!r}")
        added = write_version(fresh, store_path, method, replace)
    rows = read_versions(spark, store_path, method)
    if not replace:
        rows = rows.join(keyed.select(*keys), keys, "left_semi")
    reused = F.lit(True) if added is None else F.col("version") < added
    return rows.select(*keys, "embedding", reused.alias("reused"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder: the store changes under it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

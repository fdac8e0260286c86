"""Named queries over the given tables, one per operator group of the
inventory. Each takes (spark, sf_dir) and returns a DataFrame whose column
names equal the oracle's (``duck_oracle``). All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.functions.text import (clean_words, explode_values, render_prompt, vectorizer_terms,
                                   word_tokens)
from quarry.operators import bm25, evaluate, models, prep, tfidf, vectors
from quarry.operators.dense import dense_search
from quarry.operators.passages import containing_documents
from quarry.plans import search as S
from quarry.plans.ingest import ingest_pages
from quarry.session import shared_dir
from quarry.sources import files, pages
from quarry.sources import tables as T

# Built-in stand-ins for the queries that need some model; the batch-function
# ports are shown by hash_embed, pair_similarity and generate_hypotheses.
ENCODER = models.HashEncoder()
SCORER = models.JaccardScorer()
GENERATOR = models.WordsGenerator()
PROJECTION_SOURCES = ("src1", "src3", "src5", "src7")
R6 = 6


def _r(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), R6).alias(name or c)


# --- sources and sinks -------------------------------------------------------

def pages_extract(spark, sf):
    return pages.extract_pages(T.table(spark, sf, "pages"))


def pages_links(spark, sf):
    return pages.extract_links(T.table(spark, sf, "pages"))


def csv_roundtrip(spark, sf):
    docs = T.table(spark, sf, "documents")
    path = shared_dir(spark, "csv_roundtrip")
    files.write_papers(docs, path)
    return files.read_papers(spark, path, docs.schema)


def word_vectors_roundtrip(spark, sf):
    path = shared_dir(spark, "word_vectors")
    files.write_word_vectors(T.word_vectors(spark, sf), path)
    wv = files.read_word_vectors(spark, path)
    return wv.select("word", F.posexplode("vector").alias("pos", "value")).select(
        "word", F.col("pos").cast("int").alias("pos"), F.col("value").cast("int").alias("value"))


def _hash_store_rows(spark, sf):
    docs = T.documents(spark, sf)
    emb = models.embed_documents(docs, ENCODER)
    return (emb.join(docs.select("doc_id", F.sha2("content", 256).alias("content_hash")), "doc_id")
            .withColumn("method", F.lit("hash")))


def embeddings_roundtrip(spark, sf):
    path = shared_dir(spark, "embeddings")
    files.save_embeddings(_hash_store_rows(spark, sf), path, mode="overwrite")
    back = files.load_embeddings(spark, path, "hash")
    return back.select("method", "doc_id", "content_hash",
                       F.posexplode("embedding").alias("pos", "value")).select(
        "method", "doc_id", "content_hash", F.col("pos").cast("int").alias("pos"), _r("value"))


def metrics_roundtrip(spark, sf):
    m = metrics_per_query(spark, sf)
    path = shared_dir(spark, "metrics")
    files.write_metrics(m, path)
    return files.read_metrics(spark, path, m.schema).select(*m.columns)


def documents_validate(spark, sf):
    emb = T.vector_corpus(spark, sf)
    return prep.validate_documents(T.documents(spark, sf), emb)


# --- preparation -------------------------------------------------------------

def dedup_documents(spark, sf):
    return prep.dedup_by_content(T.documents(spark, sf))


def documents_projection(spark, sf):
    d = prep.keep_in(T.table(spark, sf, "documents"), "source", PROJECTION_SOURCES)
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))


def ingest_papers(spark, sf):
    """O02 -> O04 -> O01 -> O09 -> O16 -> O08: pages to a document table."""
    return ingest_pages(T.table(spark, sf, "pages"), shared_dir(spark, "papers"))


# --- text --------------------------------------------------------------------

def clean_tokens(spark, sf):
    return prep.count_values(T.documents(spark, sf), clean_words("content"), "word", "n")


def tokens_bm25(spark, sf):
    d = T.documents(spark, sf)
    return explode_values(d, word_tokens("content", bm25.TOKEN), "token", keep=["doc_id"], pos="pos")


def tokens_vectorizer(spark, sf):
    d = vectorizer_terms(T.documents(spark, sf))
    return explode_values(d, "terms", "term", keep=["doc_id"], pos="pos")


def term_frequency(spark, sf):
    return tfidf.term_frequency(T.documents(spark, sf))


def smooth_idf(spark, sf):
    d = T.documents(spark, sf)
    tf = tfidf.term_frequency(d)
    out = tfidf.smooth_idf(tf, d.select(F.count(F.lit(1))).scalar())
    return out.select("term", "df", _r("idf"))


def tfidf_weights(spark, sf):
    return tfidf.tfidf(T.documents(spark, sf)).select("doc_id", "term", _r("weight"))


def prompt_render(spark, sf):
    q = T.conversation_queries(spark, sf)
    return q.select("query_id", render_prompt("query").alias("prompt"))


# --- vectors -----------------------------------------------------------------

def _word_model(spark, sf):
    """The word-vector model as a file, as a pretrained one would be."""
    path = shared_dir(spark, "word_model")
    files.write_word_vectors(T.word_vectors(spark, sf), path)
    return files.read_word_vectors(spark, path)


def word_vector_embed(spark, sf):
    emb = vectors.word_vector_embed(T.documents(spark, sf), _word_model(spark, sf))
    return vectors.long_form(emb, "doc_id")


def query_word_vector_embed(spark, sf):
    emb = vectors.query_word_vector_embed(T.queries(spark, sf), _word_model(spark, sf))
    return vectors.long_form(emb, "query_id")


def word_vector_topk(spark, sf):
    """The word-vector method end to end: documents embedded with tf-idf
    weighted word vectors (O26), queries with their own counts (O61, S11),
    exact cosine top-k (O65)."""
    return S.search(T.documents(spark, sf), T.queries(spark, sf), SearchConfig(),
                    vectors.WordVectorEncoder(_word_model(spark, sf)))


def hash_embed(spark, sf):
    return vectors.long_form(models.embed_documents(T.documents(spark, sf), models.hash_encoder()), "doc_id")


def hyde_mean(spark, sf):
    hv = models.embed_documents(
        T.hypotheses(spark, sf).select(F.col("query_id").alias("doc_id"), F.col("text").alias("content")),
        ENCODER).withColumnRenamed("doc_id", "query_id")
    return vectors.long_form(vectors.hyde_mean(hv), "query_id")


def generate_hypotheses(spark, sf):
    return models.generate_hypotheses(T.conversation_queries(spark, sf), models.first_words_generator())


# --- retrieval ---------------------------------------------------------------

def cosine_topk(spark, sf):
    """Every stored vector against every other: the query set is the table, so
    both sides are dealt into tiles and nothing is broadcast."""
    return dense_search(T.vector_corpus(spark, sf), T.vector_queries(spark, sf), max_broadcast_bytes=0)


def bm25_topk(spark, sf):
    return bm25.bm25_search(T.documents(spark, sf), T.queries(spark, sf))


def bm25_index_topk(spark, sf):
    """The same ranking from a stored index (built once, then searched)."""
    path = shared_dir(spark, "bm25_index")
    bm25.build_bm25_index(T.documents(spark, sf), path)
    return bm25.bm25_search_index(spark, path, T.queries(spark, sf))


def dense_hash_topk(spark, sf):
    return S.search(T.documents(spark, sf), T.queries(spark, sf), SearchConfig(), ENCODER)


def rrf_hybrid(spark, sf):
    return S.search(T.documents(spark, sf), T.queries(spark, sf), SearchConfig(use_bm25=True), ENCODER)


def hyde_topk(spark, sf):
    return S.search(T.documents(spark, sf), T.conversation_queries(spark, sf),
                    SearchConfig(use_hyde=True), ENCODER, hypotheses=T.hypotheses(spark, sf))


def _search_flags(cfg: SearchConfig, words: bool = False):
    """One flag combination through the one search entry, with the hash encoder
    or with the word-vector method."""
    def run(spark, sf):
        encoder = vectors.WordVectorEncoder(_word_model(spark, sf)) if words else ENCODER
        out = S.search(T.documents(spark, sf), T.queries(spark, sf), cfg, encoder,
                       make_generator=GENERATOR, make_scorer=SCORER)
        if cfg.use_evaluator:
            out = out.withColumn("similarity", F.round("similarity", R6))
        return out
    run.__name__ = f"{'word' if words else 'search'}_flags_{cfg.key}"
    return run


def stream_search(spark, sf):
    """The request path as a stream: benchmark passages arrive through a file
    stream source and each micro-batch is searched (dense + BM25L fusion)
    against document vectors computed once."""
    from quarry.streaming.search_stream import start_search_stream

    docs = T.documents(spark, sf)
    shared_dir(spark)
    vecs = models.embed_documents(docs, ENCODER).checkpoint()
    stream = (spark.readStream.schema("item_id long, text string")
              .option("maxFilesPerTrigger", "1").parquet(f"{sf.rstrip('/')}/benchmark*.parquet"))
    qs = stream.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"),
                       F.lit(10).alias("top_k"))
    out = shared_dir(spark, "stream_search_out")
    index = shared_dir(spark, "stream_bm25_index")
    bm25.build_bm25_index(docs, index)
    h = start_search_stream(qs, docs, vecs, SearchConfig(use_bm25=True), ENCODER, out,
                            available_now=True, bm25_index=index)
    h.awaitTermination()
    if h.exception() is not None:
        raise RuntimeError(str(h.exception()))
    return spark.read.parquet(out).select("query_id", "rank", "doc_id", "score")


def ingest_search(spark, sf):
    """Pages -> CSV -> documents by title -> embedding store -> dense and hybrid
    search and their listing, all by text ids."""
    docs = ingest_pages(T.table(spark, sf, "pages"), shared_dir(spark, "search_papers"))
    shared_dir(spark)
    docs = docs.checkpoint()
    store, index = shared_dir(spark, "search_store"), shared_dir(spark, "search_index")
    S.get_or_create_embeddings(docs, ENCODER, store, "hash")
    bm25.build_bm25_index(docs, index)
    out = None
    for name, cfg in (("dense", SearchConfig()), ("hybrid", SearchConfig(use_bm25=True))):
        run = S.search(docs, T.queries(spark, sf), cfg, ENCODER, store=store, method="hash", bm25_index=index)
        listing = S.search_listing(run, docs).drop("similarity").withColumn("method", F.lit(name))
        out = listing if out is None else out.unionByName(listing)
    return out


def listing_unknown_documents(spark, sf):
    """A run that names documents outside the corpus: every rank is listed."""
    run = bm25.bm25_search(T.documents(spark, sf), T.queries(spark, sf))
    run = run.withColumn("doc_id", F.when(F.col("rank") == 2, -F.col("query_id") - 1).otherwise(F.col("doc_id")))
    return S.search_listing(run, T.documents(spark, sf)).drop("similarity")


def pair_similarity(spark, sf):
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    run = bm25.bm25_search(docs, qs)
    out = S.attach_similarity(run, docs, qs, models.jaccard_scorer())
    return out.select("query_id", "rank", "doc_id", _r("similarity"))


def search_listing(spark, sf):
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    run = S.attach_similarity(bm25.bm25_search(docs, qs), docs, qs, SCORER)
    out = S.search_listing(run, docs)
    return out.withColumn("similarity", F.round("similarity", R6))


def embeddings_missing(spark, sf):
    """Store pre-filled with the English documents; the rest must be embedded."""
    docs = T.documents(spark, sf)
    path = shared_dir(spark, "store")
    en = T.table(spark, sf, "documents").filter(F.col("lang") == "en").select(
        "doc_id", F.col("text").alias("content"))
    S.get_or_create_embeddings(en, ENCODER, path, "hash")
    got = prep.select_method(files.load_embeddings(spark, path), "hash")
    got.limit(1).count()
    out = S.get_or_create_embeddings(docs, ENCODER, path, "hash")
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return out.select("doc_id", "content_hash", "reused", total.alias("emb_sum"))


def store_force_keeps_methods(spark, sf):
    """Two methods stored, one rebuilt by force: both are whole afterwards."""
    docs = T.documents(spark, sf)
    path = shared_dir(spark, "store_force")
    wide = models.HashEncoder(dims=4)
    S.get_or_create_embeddings(docs, ENCODER, path, "hash")
    S.get_or_create_embeddings(docs, wide, path, "hash4")
    S.get_or_create_embeddings(docs, wide, path, "hash4", force=True)
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return files.load_embeddings(spark, path).select("method", "doc_id", total.alias("emb_sum"))


def store_changed_text(spark, sf):
    """Texts of one source change after they were stored: the store then holds
    one vector per document, that of its current text."""
    docs = T.table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    path = shared_dir(spark, "store_changed")
    S.get_or_create_embeddings(docs, ENCODER, path, "hash")
    longer = F.concat(F.coalesce("content", F.lit("")), F.lit(" changed words"))
    now = docs.withColumn("content", F.when(F.col("source") == "src1", longer).otherwise(F.col("content")))
    S.get_or_create_embeddings(now, ENCODER, path, "hash")
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return files.load_embeddings(spark, path, "hash").select("doc_id", "content_hash", total.alias("emb_sum"))


def _three_stored(spark, sf, docs):
    """Three methods kept in one store: two hash encoders and the word vectors."""
    path = shared_dir(spark, "three_methods")
    encoders = {"hash": ENCODER, "hash4": models.HashEncoder(dims=4),
                "words": vectors.WordVectorEncoder(_word_model(spark, sf))}
    for name, encoder in encoders.items():
        S.get_or_create_embeddings(docs, encoder, path, name)
    return path, {name: S.Method(encoder, store=path, stored_as=name) for name, encoder in encoders.items()}


def store_methods(spark, sf):
    """The methods to choose from, with what is stored of each."""
    path, _ = _three_stored(spark, sf, T.documents(spark, sf))
    sizes = files.load_embeddings(spark, path).groupBy("method").agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dims"),
        F.count("unit").alias("searchable"))
    return files.list_methods(spark, path).join(sizes, "method", "left")


# --- evaluation --------------------------------------------------------------

METHODS = ["bm25", "dense", "hybrid"]


def _qrels(spark, sf):
    passages = T.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return containing_documents(T.documents(spark, sf), passages)


def qrels_resolve(spark, sf):
    return evaluate.resolve_qrels(_qrels(spark, sf), T.documents(spark, sf))


def mark_relevant(spark, sf):
    run = bm25_topk(spark, sf)
    return evaluate.mark_relevant(run, evaluate.resolve_qrels(_qrels(spark, sf), T.documents(spark, sf))
                                  ).select("query_id", "rank", "doc_id", "relevant")


def _runs(spark, sf):
    """Three methods, one job: BM25L alone, dense, and their fusion; every
    returned row scored by the pair scorer."""
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    cfg = {"dense": SearchConfig(use_evaluator=True),
           "hybrid": SearchConfig(use_bm25=True, use_evaluator=True)}
    return S.search_many(docs, qs, cfg, ENCODER, make_scorer=SCORER, bm25_method="bm25",
                         score_bm25=True)


def metrics_per_query(spark, sf):
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    m = evaluate.metrics_per_query(_runs(spark, sf), _qrels(spark, sf), docs, qs, METHODS)
    return evaluate.round_metrics(m)


def metrics_per_method(spark, sf):
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    m = evaluate.metrics_per_query(_runs(spark, sf), _qrels(spark, sf), docs, qs, METHODS)
    return evaluate.round_metrics(evaluate.metrics_per_method(m))


STORED_CONFIGS = {f"{int(h)}{int(b)}": SearchConfig(use_hyde=h, use_bm25=b, use_evaluator=True)
                  for h in (False, True) for b in (False, True)}


def metrics_stored_methods(spark, sf):
    """The whole comparison: every stored method under every flag, in one
    evaluation of one job's runs, from the store and a stored BM25L index."""
    docs, qs = T.documents(spark, sf), T.queries(spark, sf)
    index = shared_dir(spark, "stored_methods_index")
    bm25.build_bm25_index(docs, index)
    _, methods = _three_stored(spark, sf, docs)
    runs = S.search_many(docs, qs, STORED_CONFIGS, methods=methods, make_generator=GENERATOR,
                         make_scorer=SCORER, bm25_index=index)
    names = [f"{m} {c}" for m in methods for c in STORED_CONFIGS]
    m = evaluate.metrics_per_query(runs, _qrels(spark, sf), docs, qs, names)
    return evaluate.round_metrics(evaluate.metrics_per_method(m))


def judged_titles(spark, sf):
    """Judgments given as lists of titles, ten pages a query, some unknown."""
    docs = ingest_pages(T.table(spark, sf, "pages"), shared_dir(spark, "judged_papers"))
    lists = pages.extract_pages(T.table(spark, sf, "pages")).groupBy(
        F.floor(F.col("page_id") / 10).alias("query_id")).agg(F.collect_list("title").alias("titles"))
    lists = lists.withColumn("titles", F.concat("titles", F.slice("titles", 1, 2), F.array(F.lit("no such title"))))
    return evaluate.title_judgments(lists, docs)


def recall_multi_hit(spark, sf):
    return metrics_per_query(spark, sf).select("method", "query_id", "recall_multi_hit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "pages_extract": pages_extract,
        "pages_links": pages_links,
        "csv_roundtrip": csv_roundtrip,
        "ingest_papers": ingest_papers,
        "documents_validate": documents_validate,
        "word_vectors_roundtrip": word_vectors_roundtrip,
        "embeddings_roundtrip": embeddings_roundtrip,
        "metrics_roundtrip": metrics_roundtrip,
        "dedup_documents": dedup_documents,
        "documents_projection": documents_projection,
        "clean_tokens": clean_tokens,
        "tokens_bm25": tokens_bm25,
        "tokens_vectorizer": tokens_vectorizer,
        "term_frequency": term_frequency,
        "smooth_idf": smooth_idf,
        "tfidf": tfidf_weights,
        "prompt_render": prompt_render,
        "word_vector_embed": word_vector_embed,
        "query_word_vector_embed": query_word_vector_embed,
        "word_vector_topk": word_vector_topk,
        "hash_embed": hash_embed,
        "hyde_mean": hyde_mean,
        "generate_hypotheses": generate_hypotheses,
        "cosine_topk": cosine_topk,
        "bm25_topk": bm25_topk,
        "bm25_index_topk": bm25_index_topk,
        "dense_hash_topk": dense_hash_topk,
        "rrf_hybrid": rrf_hybrid,
        "hyde_topk": hyde_topk,
        "stream_search": stream_search,
        "pair_similarity": pair_similarity,
        "search_listing": search_listing,
        "ingest_search": ingest_search,
        "listing_unknown_documents": listing_unknown_documents,
        "embeddings_missing": embeddings_missing,
        "store_force_keeps_methods": store_force_keeps_methods,
        "store_changed_text": store_changed_text,
        "qrels_resolve": qrels_resolve,
        "mark_relevant": mark_relevant,
        "metrics_per_query": metrics_per_query,
        "metrics_per_method": metrics_per_method,
        "recall_multi_hit": recall_multi_hit,
        "store_methods": store_methods,
        "metrics_stored_methods": metrics_stored_methods,
        "judged_titles": judged_titles,
    }
    for h in (False, True):
        for b in (False, True):
            for e in (False, True):
                cfg = SearchConfig(use_hyde=h, use_bm25=b, use_evaluator=e)
                q[f"search_flags_{cfg.key}"] = _search_flags(cfg)
                q[f"word_flags_{cfg.key}"] = _search_flags(cfg, words=True)
    return q

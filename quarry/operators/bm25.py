"""BM25L retrieval.

For distinct query term t and document d, c = count(t, d) / (1 - b + b*len(d)/avglen):

    idf(t)   = ln((N + 1) / (df(t) + 0.5))      (0 when df = 0)
    tf(t, d) = (1 + k1) * (c + delta) / (k1 + c + delta)
    score(d) = sum over t of idf(t) * tf(t, d)

tf is positive even for an absent term, so every document scores at least
``baseline(q) = absent_tf * sum(idf)``:

    score = baseline(q) + sum over *matched* terms of idf * (tf - absent_tf)

The direct search reads the corpus twice and never shuffles it. One pass counts
documents, lengths and the document frequencies of the query terms (a partial
aggregate). In the second a document is one row: each task counts the
query terms of its documents against broadcast query blocks of a bounded size,
adds the gains up and keeps a running best k per query, so k rows per query and
task leave it. Documents without content are not searched.

The stored index keeps postings by term, in blocks of documents with the largest
count and the least length of a block. Both bound what a block's documents can
gain, so a search scores only the blocks that can still reach a query's best k.
A tile of blocks is searched by one task and sends k rows per query; no
(query, document) row is shuffled to be summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from quarry.config import Bm25Params
from quarry.functions.text import WORD_1PLUS, explode_values, word_tokens
from quarry.functions.words import source_slices, word_lists, words_source
from quarry.operators.dense import QUERY_CHUNK, Best, as_ids, candidate_schema
from quarry.plans.joins import DEFAULT_BROADCAST_ROWS, salted_hot_join
from quarry.plans.topk import (OUTPUT_PLACES, SCORE_PLACES, max_k, ranked, ranking_order, requested_k,
                               top_k_per_group)
from quarry.session import shared_dir

# The in-memory store's token: a run of one or more word characters.
TOKEN = WORD_1PLUS
# (query, term) pairs of one broadcast block.
BLOCK_PAIRS = 500_000
# Documents, and (query, document) cells, scored at once inside a task.
DOC_CHUNK = 1024
SCORE_CELLS = 4_000_000


def tokenize(documents: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(doc_id, tokens) with the store's tokenizer (O47); no content, no row."""
    return documents.filter("content IS NOT NULL").select("doc_id", word_tokens("content", pattern).alias("tokens"))


def _sources(documents: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, words, bytes): the same documents and tokens, to be cut in the tasks (``word_lists``)."""
    return documents.filter("content IS NOT NULL").select(
        "doc_id", words_source(F.lower("content"), pattern).alias("words"), F.octet_length("content").alias("bytes"))


def query_terms(queries: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """Distinct (query_id, term) of each query (a blank query has none)."""
    return explode_values(queries, F.array_distinct(word_tokens("query", pattern)), "term",
                          keep=["query_id"])


def corpus_counts(documents: DataFrame, terms: DataFrame, pattern: str = TOKEN,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """O28 in one pass: (term, df, tokens) for the given ``terms`` (distinct, pinned) and
    one row with the term "" (no token is empty): the number of documents and of all tokens.

    Terms that are bounded are sent to the tasks, and each task counts in its own rows;
    beyond that the tokens meet the terms in a join."""
    if terms.count() <= max_broadcast_rows:
        # Proven above: at most max_broadcast_rows terms pass through the driver.
        vocabulary = documents.sparkSession.sparkContext.broadcast(
            pa.array(sorted(r[0] for r in terms.toLocalIterator()), pa.string()))
        each = _sources(documents, pattern).select("words").mapInArrow(
            _term_counter(vocabulary, pattern), "term string, df long, tokens long")
        return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))
    toks = tokenize(documents, pattern).select(F.size("tokens").cast("long").alias("doc_len"), "tokens")
    wanted = terms.unionByName(documents.sparkSession.createDataFrame([("",)], "term string"))
    each = explode_values(toks, F.concat(F.array_distinct("tokens"), F.array(F.lit(""))), "term", keep=["doc_len"])
    return (each.join(wanted, "term", "left_semi").groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("doc_len").alias("tokens")))


def _term_counter(vocabulary, pattern: str):
    """mapInArrow body: (words) -> (term, df, tokens) of the partition's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        docs, df, tokens = 0, np.zeros(len(words), np.int64), np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for _, part in source_slices(batch.column("words"), DOC_CHUNK):
                doc, term, _, lengths = _term_documents(word_lists(part, pattern), words)
                docs += len(lengths)
                df += np.bincount(term, minlength=len(words))
                tokens[:-1] += np.bincount(term, lengths[doc], len(words)).astype(np.int64)
                tokens[-1] += lengths.sum()
        used = np.flatnonzero(df)
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.take(pa.array(used)), pa.array([""], pa.string())]),
                 pa.array(np.append(df[used], docs)), pa.array(np.append(tokens[used], tokens[-1]))],
                ["term", "df", "tokens"])
    return run


def _term_documents(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each term of the vocabulary in each document, and the
    documents' lengths. A word is looked up once in a chunk, and only words found count."""
    lengths = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = known[coded.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    seen, count = np.unique((doc * len(vocabulary) + term)[term >= 0], return_counts=True)
    return seen // max(len(vocabulary), 1), seen % max(len(vocabulary), 1), count, lengths


def _block_scorer(block, avg_len: float, k: int, params: Bm25Params, pattern: str):
    """mapInArrow body: (doc_id, words) -> the partition's best k per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, baselines, vocabulary, first, query, idf = block.value
        best = [Best(min(QUERY_CHUNK, len(qids) - at), k) for at in range(0, len(qids), QUERY_CHUNK)]
        step = max(1, min(DOC_CHUNK, SCORE_CELLS // len(qids)))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            batch = batch.take(pc.sort_indices(batch.column("doc_id")))
            for at, part in source_slices(batch.column("words"), step):
                ids, gains = as_ids(batch.column("doc_id").slice(at, len(part)).to_pylist()), _gains(
                    word_lists(part, pattern), vocabulary, first, query, idf, len(qids), avg_len, params)
                for c, b in enumerate(best):
                    at_q = c * QUERY_CHUNK
                    b.add(gains[at_q:at_q + len(b.ids)] + baselines[at_q:at_q + len(b.ids), None], ids)
        for c, b in enumerate(best):
            rows = b.rows(qids[c * QUERY_CHUNK:c * QUERY_CHUNK + len(b.ids)])
            if len(rows):
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)
    return run


def _gains(tokens: pa.ListArray, vocabulary, first, query, idf, n_queries: int, avg_len: float,
           params: Bm25Params) -> np.ndarray:
    """Sum of gains of each (query, document of the chunk) as a matrix."""
    doc, term, count, lengths = _term_documents(tokens, vocabulary)
    k1, b, delta = params.k1, params.b, params.delta
    c = count / ((1.0 - b) + b * lengths[doc] / avg_len) if len(doc) else np.zeros(0)
    gain = (1.0 + k1) * (c + delta) / (k1 + c + delta) - params.absent_tf
    # Every matched term goes to the queries that hold it.
    each = first[term + 1] - first[term]
    entry = np.repeat(first[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    cell = query[entry] * len(lengths) + np.repeat(doc, each)
    sums = np.bincount(cell, np.repeat(gain, each) * idf[entry], n_queries * len(lengths))
    return sums.reshape(n_queries, len(lengths))


def _query_block(rows: pd.DataFrame, params: Bm25Params):
    """Queries of a block with their terms: ids, baselines and, by term, queries and idf."""
    qids = sorted(set(rows["query_id"]))
    number = {q: i for i, q in enumerate(qids)}
    rows = rows.assign(q=[number[q] for q in rows["query_id"]]).sort_values(["term", "q"], kind="stable")
    vocabulary, first = np.unique(rows["term"].to_numpy(dtype=object), return_index=True)
    baselines = np.zeros(len(qids))
    np.add.at(baselines, rows["q"].to_numpy(), rows["idf"].to_numpy() * params.absent_tf)
    return (as_ids(qids), baselines, pa.array(vocabulary.tolist(), pa.string()), np.append(first, len(rows)),
            rows["q"].to_numpy(), rows["idf"].to_numpy())


def bm25_scores(documents: DataFrame, queries: DataFrame, params: Bm25Params = Bm25Params(),
                pattern: str = TOKEN, k_max: int | None = None,
                max_broadcast_rows: int = BLOCK_PAIRS) -> DataFrame:
    """Candidate (query_id, doc_id, score): each task's best k_max per query."""
    spark = documents.sparkSession
    if k_max is None:
        k_max = max_k(queries)
    schema = candidate_schema(documents, queries)
    out = spark.createDataFrame([], schema)
    shared_dir(spark)
    qterms = query_terms(queries, pattern).checkpoint()
    pairs = qterms.count()
    counts = corpus_counts(documents, qterms.select("term").distinct().checkpoint(), pattern).checkpoint()
    corpus = counts.filter("term = ''").first()
    if corpus is None or not corpus["tokens"] or k_max <= 0:
        return out
    idf = F.log((F.lit(float(corpus["df"])) + 1.0) / (F.col("df") + 0.5))
    qidf = qterms.join(counts, "term").select("query_id", "term", idf.alias("idf")).checkpoint()
    avg_len, blocks = corpus["tokens"] / corpus["df"], math.ceil(pairs / max(1, max_broadcast_rows))
    docs = _sources(documents, pattern).select("doc_id", "words")
    for b in range(blocks):
        part = qidf if blocks == 1 else qidf.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        # One block at a time passes through the driver, about max_broadcast_rows rows.
        rows = part.toPandas()
        if len(rows):
            block = spark.sparkContext.broadcast(_query_block(rows, params))
            out = out.unionByName(docs.mapInArrow(_block_scorer(block, avg_len, k_max, params, pattern), schema))
    return out


def _finish(scores: DataFrame, qk: DataFrame, k_max: int) -> DataFrame:
    out = ranked(scores, qk.select("query_id", "top_k"), k_max)
    return (out.filter(F.col("score") > 0)  # O15
            .select("query_id", "rank", "doc_id",
                    F.round("score", OUTPUT_PLACES).alias("score")))


def bm25_search(documents: DataFrame, queries: DataFrame, params: Bm25Params = Bm25Params(),
                pattern: str = TOKEN, top_k_col: str = "top_k",
                max_broadcast_rows: int = BLOCK_PAIRS) -> DataFrame:
    """(query_id, rank, doc_id, score), top ``top_k`` per query, scores > 0.

    documents: (doc_id, content); queries: (query_id, query, top_k)."""
    qk = queries.select("query_id", "query", requested_k(top_k_col).alias("top_k"))
    k_max = max_k(qk)
    return _finish(bm25_scores(documents, qk, params, pattern, k_max, max_broadcast_rows), qk, k_max)


# ---------------------------------------------------------------------------
# Stored index: build once, search many times (the reference builds its store
# once at start-up). Postings are written partitioned by a hash bucket of the
# term, so a search reads only the buckets its query terms fall in (static
# partition pruning on the bounded list of needed buckets).
# ---------------------------------------------------------------------------

# Text bytes whose postings make one bucket, and documents whose rows of one
# term make one written file, about.
BUCKET_BYTES = 128 << 20
FILE_DOCS = 2_000_000
LEAST_BUCKETS = 32
# Documents of a block; blocks of a tile (a power of two).
BLOCK_DOCS = 128
TILE_BLOCK_BITS = 8
# The bucket of the rows with the term "": a block's documents and lengths.
DOCUMENT_BUCKET = -1
# Bounds and scores are sums in different orders; ranks are on rounded scores.
SLACK = 1e-8


def _bucket(col: str, buckets: int):
    return F.when(F.col(col) == "", DOCUMENT_BUCKET).otherwise(
        F.pmod(F.xxhash64(F.col(col)), F.lit(buckets))).cast("int")


def _index_schema(id_type: DataType) -> StructType:
    """A row of the postings but for its bucket."""
    numbers = ArrayType(IntegerType())
    return StructType([
        StructField("term", StringType()), StructField("tile", LongType()), StructField("block", LongType()),
        StructField("n", IntegerType()), StructField("max_tf", IntegerType()), StructField("min_len", IntegerType()),
        StructField("pos", numbers), StructField("ids", ArrayType(id_type)),
        StructField("lens", numbers), StructField("tfs", numbers)])


def _stored(spark, path: str, id_type: DataType) -> DataFrame:
    return spark.read.schema(_index_schema(id_type).add("term_bucket", IntegerType())).parquet(f"{path}/postings")


def _block_postings(block_docs: int, schema: pa.Schema, pattern: str):
    """mapInArrow body: (doc_id, words) -> one row for each block and term, and one
    with the term "" (no token is empty) that lists the block's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, part in source_slices(batch.column("words"), block_docs):
                yield pa.RecordBatch.from_pydict(_block_rows(
                    batch.column("doc_id").slice(at, len(part)), word_lists(part, pattern), block), schema=schema)
                block += 1
    return run


def _block_rows(docs: pa.Array, tokens: pa.ListArray, block: int) -> dict[str, pa.Array]:
    n = len(docs)
    lengths = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen, counts = np.unique(code * n + np.repeat(np.arange(n), lengths), return_counts=True)
    first = np.flatnonzero(np.diff(seen // n, prepend=-1))
    pos = np.concatenate([np.arange(n), seen % n])
    tfs, starts = np.concatenate([np.zeros(n, np.int64), counts]), np.concatenate([[0], n + first])
    rows, ends = len(starts), np.append(starts, len(pos)).astype(np.int32)
    terms = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string()).take(
        pa.array(seen[first] // n))])

    def lists(values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))

    def whole(values) -> pa.Array:
        return pa.array(values, pa.int32())

    return {"term": terms, "tile": pa.array(np.full(rows, block >> TILE_BLOCK_BITS)), "block": pa.array(np.full(rows, block)),
            "n": whole(np.diff(ends)), "max_tf": whole(np.maximum.reduceat(tfs, starts)),
            "min_len": whole(np.minimum.reduceat(lengths[pos], starts)), "pos": lists(pos),
            "ids": pa.ListArray.from_arrays(pa.array(ends), docs.take(pa.array(pos))),
            "lens": lists(lengths[pos]), "tfs": lists(tfs)}


def build_bm25_index(documents: DataFrame, path: str, pattern: str = TOKEN,
                     buckets: int | None = None, block_docs: int = BLOCK_DOCS) -> None:
    """Write postings (term_bucket, term, tile, block, n, max_tf, min_len, pos, ids, lens,
    tfs: a row is a term in a block of documents), document frequencies (term_bucket,
    term, df) and corpus statistics. Texts are tokenized once.

    Documents are put into blocks where they lie, by their bytes, so that lengths in a
    block are alike and the bounds tight. The number of buckets (unless given) and of
    the tasks that write one term follow the corpus."""
    spark = documents.sparkSession
    kept = documents.filter("content IS NOT NULL")
    n_docs, n_bytes = kept.agg(F.count(F.lit(1)), F.sum(F.octet_length("content"))).first()
    if buckets is None:
        buckets = max(LEAST_BUCKETS, math.ceil((n_bytes or 0) / BUCKET_BYTES))
    splits = max(1, math.ceil(n_docs / FILE_DOCS))
    id_type = documents.schema["doc_id"].dataType
    schema = _index_schema(id_type)
    blocks = (_sources(documents, pattern).sortWithinPartitions("bytes", "doc_id").drop("bytes")
              .mapInArrow(_block_postings(block_docs, to_arrow_schema(schema), pattern), schema)
              .withColumn("term_bucket", _bucket("term", buckets)))
    # One shuffle at build time: rows of a bucket go to few tasks (few files per
    # folder), split by tile so that a very common word is written by several
    # tasks; sorted by term so that row-group statistics narrow the reads further.
    salt = F.pmod(F.xxhash64("tile"), F.lit(splits))
    (blocks.repartition("term_bucket", salt).sortWithinPartitions("term", "tile", "block")
     .write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings"))
    stored = _stored(spark, path, id_type)
    (stored.filter(F.col("term_bucket") != DOCUMENT_BUCKET).groupBy("term_bucket", "term")
     .agg(F.sum("n").alias("df")).write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/df"))
    lengths = F.aggregate("lens", F.lit(0).cast("long"), lambda acc, n: acc + n)
    (stored.filter(F.col("term_bucket") == DOCUMENT_BUCKET)
     .agg(F.sum("n").alias("n_docs"), (F.sum(lengths) / F.sum("n")).alias("avg_len"))
     .withColumn("buckets", F.lit(int(buckets))).withColumn("pattern", F.lit(pattern))
     .withColumn("id_type", F.lit(id_type.simpleString()))
     .write.mode("overwrite").parquet(f"{path}/stats"))


def _tf_gain(tf: np.ndarray, length: np.ndarray, avg_len: float, params: Bm25Params) -> np.ndarray:
    c = tf / ((1.0 - params.b) + params.b * length / avg_len)
    return (1.0 + params.k1) * (c + params.delta) / (params.k1 + c + params.delta) - params.absent_tf


class _Tile:
    """The postings of one tile's blocks, for any number of queries."""

    def __init__(self, rows: pa.Table, avg_len: float, params: Bm25Params):
        rows = rows.combine_chunks()
        self.avg_len, self.params = avg_len, params
        self.block = rows.column("block").to_numpy()
        # What a document of the block can gain at most, for an idf of 1.
        self.most = _tf_gain(rows.column("max_tf").to_numpy(), rows.column("min_len").to_numpy(), avg_len, params)
        one = {c: rows.column(c).chunk(0) for c in ("pos", "ids", "lens", "tfs")}
        self.starts = one["pos"].offsets.to_numpy() - one["pos"].offsets[0].as_py()
        self.pos, self.lens, self.tfs = (one[c].flatten().to_numpy(zero_copy_only=False) for c in ("pos", "lens", "tfs"))
        self.ids = one["ids"].flatten()
        self.rows_of: dict[str, list[int]] = {}
        for i, term in enumerate(rows.column("term").to_pylist()):
            self.rows_of.setdefault(term, []).append(i)
        self.scored = self.met = 0

    def _score(self, rows: np.ndarray, idfs: np.ndarray, least: float) -> list[tuple[float, object]]:
        """(gain, id) of the documents of one block that gain ``least`` or more."""
        at = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in rows])
        gains = np.repeat(idfs, self.starts[rows + 1] - self.starts[rows]) * _tf_gain(
            self.tfs[at], self.lens[at], self.avg_len, self.params)
        pos, first, place = np.unique(self.pos[at], return_index=True, return_inverse=True)
        sums = np.bincount(place, gains, len(pos))
        good = np.flatnonzero(sums >= least)
        ids = self.ids.take(pa.array(at[first[good]])).to_pylist()
        return [(s, d) for s, d in zip(sums[good].tolist(), ids, strict=True) if d is not None]

    def best(self, terms: list[tuple[str, float]], baseline: float, k: int) -> list[tuple[float, object]]:
        """Best k (score, id) of one query. Blocks are met by falling bound, until
        none can reach the k-th score."""
        rows = np.array([r for t, _ in terms for r in self.rows_of.get(t, ())], np.int64)
        idfs = np.array([idf for t, idf in terms for _ in self.rows_of.get(t, ())])
        blocks, which = np.unique(self.block[rows], return_inverse=True)
        bound = np.bincount(which, idfs * self.most[rows], len(blocks))
        by_block = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(blocks)))
        found, least = [], -math.inf
        self.met += len(blocks)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] < least:
                break
            part = by_block[ends[b - 1] if b else 0:ends[b]]
            found += [(baseline + gain, d) for gain, d in self._score(rows[part], idfs[part], least)]
            found = sorted(found, key=lambda x: (-round(x[0], SCORE_PLACES), x[1]))[:k]
            self.scored += 1
            if len(found) == k:
                least = found[-1][0] - baseline - SLACK
        return found


def _tile_search(avg_len: float, k: int, params: Bm25Params, schema: pa.Schema):
    """Cogroup body: (postings of a tile, query terms that occur in it) -> best k per query."""
    def run(rows: pa.Table, terms: pa.Table) -> pa.Table:
        if not rows.num_rows or not terms.num_rows:
            return schema.empty_table()
        tile, queries = _Tile(rows, avg_len, params), {}
        for q, term, idf, baseline in zip(*(terms.column(c).to_pylist() for c in (
                "query_id", "term", "idf", "baseline")), strict=True):
            queries.setdefault(q, (baseline, []))[1].append((term, idf))
        out = [(q, d, s) for q, (baseline, some) in queries.items() for s, d in tile.best(sorted(some), baseline, k)]
        return pa.table([pa.array([r[i] for r in out], schema.field(i).type) for i in range(3)], schema=schema)
    return run


def bm25_search_index(spark, path: str, queries: DataFrame, params: Bm25Params = Bm25Params(),
                      top_k_col: str = "top_k",
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """O66 over a stored index: same output as ``bm25_search``."""
    meta = spark.read.parquet(f"{path}/stats").first()
    buckets, n_docs, avg_len = int(meta["buckets"]), meta["n_docs"], meta["avg_len"]
    qk = queries.select("query_id", "query", requested_k(top_k_col).alias("top_k"))
    k_max = max_k(qk)
    qterms = query_terms(qk, meta["pattern"]).withColumn("term_bucket", _bucket("term", buckets))
    # The buckets the query terms fall in: at most ``buckets`` integers. As a
    # static partition filter they make each scan list and read only those
    # folders of the index.
    pairs, needed = qterms.agg(F.count(F.lit(1)), F.collect_set("term_bucket")).first()
    id_type = StructType.fromDDL(f"id {meta['id_type']}")["id"].dataType
    stored = _stored(spark, path, id_type)
    schema = StructType([StructField("query_id", qk.schema["query_id"].dataType),
                         StructField("doc_id", id_type),
                         StructField("score", DoubleType())])
    if not pairs or not avg_len or k_max <= 0:
        return _finish(spark.createDataFrame([], schema), qk, max(k_max, 1))
    small = pairs <= max_broadcast_rows
    terms = qterms.select("term_bucket", "term").distinct()
    terms = F.broadcast(terms) if small else terms

    def part(table: DataFrame) -> DataFrame:
        return (table.filter(F.col("term_bucket").isin(needed))
                .join(terms, ["term_bucket", "term"], "left_semi"))

    idf = part(spark.read.schema("term string, df long, term_bucket int").parquet(f"{path}/df")).select(
        "term", "df", F.log((F.lit(float(n_docs)) + 1.0) / (F.col("df") + 0.5)).alias("idf"))
    # (query_id, term, idf, baseline) for the query terms that occur in the corpus.
    qidf = qterms.select("query_id", "term").join(idf.select("term", "idf"), "term").withColumn(
        "baseline", F.sum("idf").over(Window.partitionBy("query_id")) * params.absent_tf)
    # Beyond BLOCK_PAIRS pairs the queries meet a tile in blocks.
    blocks = math.ceil(pairs / BLOCK_PAIRS)
    post = part(stored).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Read anew: a cogroup cannot tell two uses of one table apart.
    tiles = part(_stored(spark, path, id_type)).select("term", "tile").distinct()
    met = (tiles.join(F.broadcast(qidf), "term") if small else
           salted_hot_join(tiles, qidf, "term", salt_from=["tile"]))
    met = met.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    found = (post.groupBy("tile", "query_block").cogroup(met.groupBy("tile", "query_block"))
             .applyInArrow(_tile_search(avg_len, k_max, params, to_arrow_schema(schema)), schema))
    found = top_k_per_group(found, ["query_id"], ranking_order(), k_max).drop("rank")
    # Documents without a query term score the baseline: the lowest k_max ids as one
    # bounded array (a scalar subquery, no cross join).
    fill_ids = (stored.filter(F.col("term_bucket") == DOCUMENT_BUCKET).select(F.explode("ids").alias("doc_id"))
                .filter("doc_id IS NOT NULL").orderBy("doc_id").limit(k_max).agg(F.collect_list("doc_id")).scalar())
    fill = qidf.select("query_id", "baseline").distinct().select(
        "query_id", F.explode(fill_ids).alias("doc_id"), F.col("baseline").alias("score"))
    # k rows per query of each kind; dealt by query once, for the sum and the ranks.
    both = found.unionByName(fill).repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return _finish(both, qk, k_max)

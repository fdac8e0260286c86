"""Word-vector document embedding and vector means.

Weighted means use Spark ML's ``Summarizer`` (a JVM aggregate with partial
aggregation), so 300-dimensional vectors are summed map-side instead of
being exploded into one row per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.functions.text import clean_words, explode_values, unigrams
from quarry.operators.tfidf import BLOCK_BYTES, block_frequencies, corpus_size, flat, idf_of, in_blocks, numbered
from quarry.plans.joins import DEFAULT_BROADCAST_ROWS, skew_join
from quarry.session import shared_dir

# Bytes of a model (words and vectors) that is broadcast.
MODEL_BYTES = 256 * 1024 * 1024
# Bytes of a word with its weight, about.
WORD_BYTES = 64
# Bits of the word filter for each word of a larger model, and at most (256 MB).
FILTER_BITS = 16
FILTER_MOST_BITS = 1 << 31
# Documents whose word vectors are summed at once in a task.
DOC_CHUNK = 256


def vector_mean(df: DataFrame, key: str, vec: str = "vector", weight: str | None = None,
                out: str = "embedding") -> DataFrame:
    """(key, out) with the element-wise (weighted) mean of ``vec`` per key."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    rows = df.select(key, v.alias("_v"), *( [F.col(weight).cast("double").alias("_w")] if weight else []))
    agg = Summarizer.mean(F.col("_v"), F.col("_w")) if weight else Summarizer.mean(F.col("_v"))
    return rows.groupBy(key).agg(agg.alias("_m")).select(key, vector_to_array("_m", "float64").alias(out))


def word_filter(words: DataFrame, n_words: int) -> Callable[[DataFrame], DataFrame]:
    """A filter of rows (word) by a bitmap over the hashes of a model's words. Every
    word of the model passes, another one with a chance of about 1 / FILTER_BITS.

    The bitmap is aggregated once, in pieces of 32,768 bits that lie apart; its
    pieces are broadcast (their bytes are bounded) and the rows stay where they are."""
    shared_dir(words.sparkSession)
    bits = min(FILTER_MOST_BITS, max(1, n_words) * FILTER_BITS)
    place = F.pmod(F.xxhash64("word"), F.lit(bits)) + 1
    pieces = (words.select(F.bitmap_bucket_number(place).alias("__piece"), F.bitmap_bit_position(place).alias("__bit"))
              .repartition("__piece").groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
              .checkpoint())

    def passing(rows: DataFrame) -> DataFrame:
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3).cast("int") + 1, 1)), 16, 10).cast("int")
        return (rows.withColumn("__piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "__piece")
                .filter(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("__piece", "__bits"))
    return passing


def model_words(word_vectors: DataFrame, n_words: int,
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A filter of rows (word) to a model's words (O18): exact while they can be
    broadcast, else by a bitmap; what passes wrongly meets no vector later."""
    words = word_vectors.select("word").filter("word IS NOT NULL")
    if n_words <= max_broadcast_rows:
        return lambda rows: rows.join(F.broadcast(words), "word", "left_semi")
    return word_filter(words, n_words)


def word_counts(documents: DataFrame, keep: Sequence[str] = (),
                known: Callable[[DataFrame], DataFrame] | None = None, stop_words=None) -> DataFrame:
    """(doc_id, *keep, word, occ, tf): how often the embedder's own tokenizer
    (O43-O45) and the vectorizer (O46, O48) find a word in a document.

    Both read the text in one row. Words that ``known`` filters out go inside the
    scan, before anything is counted or shuffled."""
    def tagged(words, occ: int, tf: int):
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(occ).alias("occ"), F.lit(tf).alias("tf")))

    found = F.concat(tagged(clean_words("content"), 1, 0), tagged(unigrams("content", stop_words), 0, 1))
    found = F.when(F.col("content").isNotNull(), found)
    rows = explode_values(documents, found, "v", keep=["doc_id", *keep]).select("doc_id", *keep, "v.*")
    if known is not None:
        rows = known(rows)
    return rows.groupBy("doc_id", *keep, "word").agg(F.sum("occ").alias("occ"), F.sum("tf").alias("tf"))


def _model_bounds(word_vectors: DataFrame) -> tuple[int, int]:
    """(words, longest vector) of a model, in one small aggregate."""
    n, dims = word_vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return n, dims or 0


def _weighted_means(documents: DataFrame, rows: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """(key, embedding) of every document; zeros when no word of it counts."""
    means = vector_mean(rows, key, "vector", "weight")
    zeros = F.array_repeat(F.lit(0.0), dims)
    return (documents.select(key).join(means, key, "left")
            .select(key, F.coalesce("embedding", zeros).alias("embedding")))


def word_vector_embed(documents: DataFrame, word_vectors: DataFrame, stop_words=None,
                      corpus: DataFrame | None = None, within: str | None = None,
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, embedding) = sum(w * v) / sum(w) over word occurrences.

    A word counts once per occurrence with its tf-idf weight (S12), and only
    if it is both a vectorizer term of that document and in the model (O18).
    The per-row L2 norm and the bigrams cancel out of the ratio (S13), so only
    unigram tf * idf is computed. Documents with no usable word get zeros.

    Document frequencies are those of ``corpus`` (default: the documents), or of
    the documents that share a value of ``within``, each a corpus by itself.

    Documents are dealt once into blocks of bounded bytes; words with their idf and
    vector come to a block, its (document, word) counts never leave its task. With
    ``within`` (answers to a query), a word's idf and vector are joined on the
    model's side and the counts meet one lookup."""
    n_words, dims = _model_bounds(word_vectors)
    model = word_vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    known = model_words(model, n_words, max_broadcast_rows)
    if within is None:
        return _embed_in_blocks(documents, documents if corpus is None else corpus, model, known, dims, stop_words)
    counts = word_counts(documents, [within], known, stop_words)
    fitted = counts if corpus is None else word_counts(corpus, [within], known, stop_words)
    sized = documents if corpus is None else corpus
    df = fitted.filter("tf > 0").groupBy(within, "word").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(sized.groupBy(within).agg(F.count(F.lit(1)).alias("n_docs")), within)
    weight = model.join(df, "word").select(within, "word", "vector", idf_of(F.col("n_docs"), F.col("df")).alias("idf"))
    rows = counts.filter("occ > 0 AND tf > 0").join(weight, [within, "word"])
    rows = rows.select("doc_id", "vector", (F.col("occ") * F.col("tf") * F.col("idf")).alias("weight"))
    return _weighted_means(documents, rows, dims)


def _embed_in_blocks(documents: DataFrame, corpus: DataFrame, model: DataFrame,
                     known: Callable[[DataFrame], DataFrame], dims: int, stop_words) -> DataFrame:
    """(doc_id, embedding) of every row. A block of documents sends a row for each of
    its words that the model has, and gets idf and vector of these back; its
    documents are averaged in its task."""
    size = corpus_size(documents)[1]
    n_docs = corpus.count()

    def frequencies(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        dealt = in_blocks(rows.select("doc_id", "content"), size, BLOCK_BYTES)
        words = dealt.select("block", "doc_id", unigrams("content", stop_words).alias("terms"),
                             F.coalesce(clean_words("content"), F.array().cast("array<string>")).alias("cleaned"))
        return words, known(block_frequencies(words, "terms", "word"))

    words, own = frequencies(documents, size)
    if corpus is documents:
        found = own.withColumn("df", F.sum("df").over(Window.partitionBy("word")))
    else:
        # A word has at most one row for each block on either side.
        df = frequencies(corpus, corpus_size(corpus)[1])[1].groupBy("word").agg(F.sum("df").alias("df"))
        found = own.drop("df").join(df, "word")
    weight = found.join(model, "word").select("block", "word", idf_of(F.lit(float(n_docs)), F.col("df")).alias("idf"),
                                              "vector")
    schema = StructType([documents.schema["doc_id"], StructField("embedding", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(docs: pa.Table, weights: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return arrow.empty_table()
        doc, ids = numbered(docs.column("doc_id"))
        means = _block_means(docs, doc, len(ids), weights, dims)[doc]
        # A row without an id shares its words with none.
        means[docs.column("doc_id").is_null().to_numpy()] = 0.0
        ends = pa.array(np.arange(docs.num_rows + 1) * dims, pa.int32())
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(),
                                     pa.ListArray.from_arrays(ends, pa.array(means.ravel()))], schema=arrow)

    return words.groupBy("block").cogroup(weight.groupBy("block")).applyInArrow(run, schema)


def _block_means(docs: pa.Table, doc: np.ndarray, n: int, weights: pa.Table, dims: int) -> np.ndarray:
    """Weighted mean vector of each of the ``n`` documents of a block; zeros where no
    word counts. A word that the model has twice counts with both vectors."""
    means = np.zeros((n, dims))
    if not weights.num_rows or not dims:
        return means
    coded = weights.column("word").combine_chunks().dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(), coded.dictionary
    idf, times, vector = np.zeros(len(vocabulary)), np.bincount(code), np.zeros((len(vocabulary), dims))
    idf[code] = weights.column("idf").to_numpy()
    np.add.at(vector, code, weights.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims))

    def counts(column: str) -> tuple[np.ndarray, np.ndarray]:
        row, words = flat(docs.column(column))
        place = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.unique((doc[row] * len(vocabulary) + place)[place >= 0], return_counts=True)

    (pair, tf), (other, occ) = counts("terms"), counts("cleaned")
    pair, i, j = np.intersect1d(pair, other, assume_unique=True, return_indices=True)
    if not len(pair):
        return means
    at, word = pair // len(vocabulary), pair % len(vocabulary)
    weight = tf[i] * occ[j] * idf[word]
    # Pairs are in the order of documents: summed a bounded number of them at once.
    first = np.flatnonzero(np.diff(at, prepend=-1))
    cuts = np.append(first, len(pair))
    for lo in range(0, len(first), DOC_CHUNK):
        hi = min(lo + DOC_CHUNK, len(first))
        span = slice(cuts[lo], cuts[hi])
        sums = np.add.reduceat(weight[span, None] * vector[word[span]], first[lo:hi] - cuts[lo])
        total = np.add.reduceat(weight[span] * times[word[span]], first[lo:hi] - cuts[lo])
        means[at[first[lo:hi]]] = sums / total[:, None]
    return means


def query_word_vector_embed(queries: DataFrame, word_vectors: DataFrame, stop_words=None) -> DataFrame:
    """O61 for word vectors: the query is its own one-document corpus, so
    every idf is 1 (S11) and the weight is the term count."""
    n_words, dims = _model_bounds(word_vectors)
    docs = queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("content"))
    model = word_vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    known = model_words(model, n_words)
    usable = word_counts(docs, known=known, stop_words=stop_words).filter("occ > 0 AND tf > 0")
    if n_words * (dims * 8 + WORD_BYTES) <= MODEL_BYTES:
        rows = usable.join(F.broadcast(model), "word")
    else:
        rows = skew_join(usable, model, "word")
    rows = rows.select("doc_id", "vector", (F.col("occ") * F.col("tf")).cast("double").alias("weight"))
    return _weighted_means(docs, rows, dims).withColumnRenamed("doc_id", "query_id")


class WordVectorEncoder:
    """The word-vector method as an encoder of whole tables (see ``models``).

    Document frequencies come from the table that is embedded, or from the
    ``corpus`` it is part of; a query's hypothetical answers are a corpus of
    their own, and so is each query."""

    def __init__(self, word_vectors: DataFrame, stop_words=None):
        self.word_vectors, self.stop_words = word_vectors, stop_words

    def embed_documents(self, documents: DataFrame, corpus: DataFrame | None = None,
                        within: str | None = None) -> DataFrame:
        return word_vector_embed(documents, self.word_vectors, self.stop_words, corpus, within)

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        return query_word_vector_embed(queries, self.word_vectors, self.stop_words)


def hyde_mean(hypothesis_vectors: DataFrame) -> DataFrame:
    """(query_id, embedding) element-wise mean of a query's hypotheses."""
    return vector_mean(hypothesis_vectors, "query_id", "embedding", None, "embedding")


def long_form(df: DataFrame, key: str, vec: str = "embedding", places: int = 6) -> DataFrame:
    """(key, pos, value) rows of a vector column, 0-based pos, rounded."""
    return df.select(key, F.posexplode(vec).alias("pos", "value")).select(
        key, F.col("pos").cast("int").alias("pos"), F.round(F.col("value").cast("double"), places).alias("value"))

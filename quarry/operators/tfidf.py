"""Term statistics and TF-IDF.

Terms are the vectorizer's: lower-cased words of 2+ characters, stop words
removed, then unigrams followed by their bigrams. A document's terms are counted
inside its row. For the weights, documents are dealt once into blocks of bounded
bytes by the hash of their ids. What is shuffled by term is one narrow row for
each block and term: a block sends its document frequencies and gets back those of the
terms that other blocks have too, at most one row of a term for each block, so no
term is hot.
The (doc, term) rows leave the block's task weighted and normalised; they are
never shuffled, joined or sorted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.functions.text import unigrams, vectorizer_terms
from quarry.operators.prep import count_values

# Text bytes of the documents of a block (one task holds its terms).
BLOCK_BYTES = 16 << 20
# Partitions for each block, so that few tasks get two.
BLOCK_SPREAD = 4


def doc_terms(documents: DataFrame, ngrams: bool = True, stop_words=None, keep=()) -> DataFrame:
    """(doc_id, *keep, terms) per document."""
    rows = documents.select("doc_id", *keep, "content")
    if ngrams:
        return vectorizer_terms(rows, "content", "terms", stop_words).drop("content")
    return rows.select("doc_id", *keep, unigrams("content", stop_words).alias("terms"))


def term_frequency(documents: DataFrame, ngrams: bool = True, stop_words=None) -> DataFrame:
    """Raw count per (doc_id, term)."""
    return count_values(doc_terms(documents, ngrams, stop_words), "terms", "term", "tf")


def idf_of(n_docs: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((n_docs + 1.0) / (df + 1.0)) + 1.0


def smooth_idf(tf: DataFrame, n_docs) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1.

    ``n_docs`` is a Column (e.g. a scalar subquery) or a number."""
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(float(n_docs))
    return (tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .withColumn("idf", idf_of(n, F.col("df"))))


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """(documents, bytes of their texts) in one small aggregate."""
    n, size = documents.agg(F.count(F.lit(1)), F.sum(F.octet_length("content"))).first()
    return n, size or 0


def in_blocks(documents: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """The documents with the number of their block, dealt by it. The rows of an id
    share a block."""
    blocks = max(1, math.ceil(size / block_bytes))
    return (documents.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
            .repartition(BLOCK_SPREAD * blocks, "block"))


def numbered(ids: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each row's document as a number, and the documents (null is one of them)."""
    coded = ids.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row number of each element of a list column, and the elements."""
    whole = lists.combine_chunks()
    return pc.list_parent_indices(whole).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def block_counts(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(document, term, count) of a block's pairs as numbers, by document; the
    documents and the terms, in ascending order, that they number."""
    doc, ids = numbered(table.column("doc_id"))
    row, values = flat(table.column(column))
    coded = values.dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary)
    terms = max(1, len(by_term))
    place = np.empty(len(by_term), np.int64)
    place[by_term.to_numpy()] = np.arange(len(by_term))
    pair, n = np.unique(doc[row] * terms + place[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    return pair // terms, pair % terms, n, ids, coded.dictionary.take(by_term)


def block_frequencies(dealt: DataFrame, column: str, term: str) -> DataFrame:
    """(block, place, term, df): in how many documents of its block a term occurs, and
    its place among the block's terms, which no order of rows changes."""
    schema = (StructType([dealt.schema["block"]]).add("place", "integer").add(term, "string").add("df", "long"))
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        _, code, _, _, terms = block_counts(table, column)
        return pa.Table.from_arrays([
            pa.repeat(table.column("block")[0], len(terms)), pa.array(np.arange(len(terms)), pa.int32()), terms,
            pa.array(np.bincount(code, minlength=len(terms)), pa.int64())], schema=arrow)

    return dealt.select("block", "doc_id", column).groupBy("block").applyInArrow(run, schema)


def tfidf(documents: DataFrame, ngrams: bool = True, stop_words=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, term, weight), L2-normalised per document."""
    n_docs, size = corpus_size(documents)
    dealt = in_blocks(documents.select("doc_id", "content").filter("content IS NOT NULL"), size, block_bytes)
    terms = doc_terms(dealt, ngrams, stop_words, keep=["block"])
    own = block_frequencies(terms, "terms", "term")
    # A term of one block only needs no row back: the block knows its frequency.
    elsewhere = (own.withColumn("total", F.sum("df").over(Window.partitionBy("term")))
                 .filter("total > df").select("block", "place", "total"))
    schema = StructType([documents.schema["doc_id"], StructField("term", StringType()),
                         StructField("weight", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return arrow.empty_table()
        doc, code, tf, ids, found = block_counts(docs, "terms")
        df = np.bincount(code, minlength=len(found))
        df[totals.column("place").to_numpy()] = totals.column("total").to_numpy()
        w = tf * (np.log((n_docs + 1.0) / (df + 1.0)) + 1.0)[code]
        norm = np.sqrt(np.bincount(doc, w * w, len(ids)))
        return pa.Table.from_arrays([ids.take(pa.array(doc)), found.take(pa.array(code)), pa.array(w / norm[doc])],
                                    schema=arrow)

    return (terms.select("block", "doc_id", "terms").groupBy("block").cogroup(elsewhere.groupBy("block"))
            .applyInArrow(run, schema))

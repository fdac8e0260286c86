"""Model scoring as batch jobs.

A model is supplied by the caller as a ``make_predict_fn`` (the standard
``pyspark.ml.functions.predict_batch_udf`` contract): it is called once per
Python worker to load the model, and the function it returns maps a numpy
batch to a numpy batch. Arrow moves the batches; no per-row Python call.

Neural weights are not bundled. The stand-ins below are deterministic and
only exercise the plumbing; they do not imitate any model's output:
  * ``hash_encoder``: sum of md5 word vectors (dim i = i-th hex digit),
  * ``jaccard_scorer``: token-set Jaccard of (query, content),
  * ``first_words_generator``: the words of the prompt, as one reply.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from quarry.functions.text import WHITESPACE, WORD_2PLUS, render_prompt, word_tokens
from quarry.functions.words import source_slices, word_lists, words_source
from quarry.operators.prep import null_to_empty

BATCH_SIZE = 256


# ---------------------------------------------------------------------------
# Stand-in models (each returns a make_predict_fn)
# ---------------------------------------------------------------------------

def hash_encoder(dims: int = 8, pattern: str = WORD_2PLUS):
    def make():
        import regex

        word = regex.compile(pattern)
        cache: dict[str, np.ndarray] = {}

        def vec(w: str) -> np.ndarray:
            v = cache.get(w)
            if v is None:
                h = hashlib.md5(w.encode("utf-8")).hexdigest()
                v = np.array([int(h[i], 16) for i in range(dims)], dtype=np.float32)
                if len(cache) < 1_000_000:
                    cache[w] = v
            return v

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in word.findall((t or "").lower()):
                    out[i] += vec(w)
            return out

        return predict

    return make


def jaccard_scorer(pattern: str = WORD_2PLUS):
    def make():
        import regex

        word = regex.compile(pattern)

        def predict(queries: np.ndarray, contents: np.ndarray) -> np.ndarray:
            out = np.zeros(len(queries), dtype=np.float64)
            for i, (q, c) in enumerate(zip(queries, contents)):
                a = set(word.findall((q or "").lower()))
                b = set(word.findall((c or "").lower()))
                u = len(a | b)
                out[i] = len(a & b) / u if u else 0.0
            return out

        return predict

    return make


def first_words_generator(max_words: int | None = None, replies: int = 1):
    """Stand-in reply: the prompt's words (whole, or the first ``max_words``)."""
    def make():
        def predict(prompts: np.ndarray) -> np.ndarray:
            out = np.empty((len(prompts), replies), dtype=object)
            for i, p in enumerate(prompts):
                out[i, :] = " ".join((p or "").split()[:max_words])
            return out

        return predict

    return make


# ---------------------------------------------------------------------------
# The same stand-ins as built-in expressions: a model object with a ``column``
# method is applied as an expression instead of a batch function; the scorer
# and the generator stay in the JVM.
# ---------------------------------------------------------------------------

class HashEncoder:
    """A task hashes the distinct words of a block of texts and adds their digits up,
    whatever the number of words in a text."""

    def __init__(self, dims: int = 8, pattern: str = WORD_2PLUS):
        self.dims, self.pattern = dims, pattern

    def column(self, text: Column) -> Column:
        sums = arrow_udf(_digit_sums(self.dims, self.pattern), ArrayType(FloatType()))
        return sums(words_source(F.lower(F.coalesce(text, F.lit(""))), self.pattern))


def _digit_sums(dims: int, pattern: str):
    """Texts -> per text, the sum of the first ``dims`` hex digits of its words' md5."""
    def sums(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dims), np.float32)
        for at, part in source_slices(texts):
            words = word_lists(part, pattern)
            bounds = words.offsets.to_numpy()
            coded = words.flatten().dictionary_encode()
            digests = b"".join(hashlib.md5(w.encode()).digest() for w in coded.dictionary.to_pylist())
            digests = np.frombuffer(digests, np.uint8).reshape(-1, 16).astype(np.uint64)
            # Two digits of a word are added at once, in the halves of one number.
            pairs = digests >> np.uint64(4) << np.uint64(32) | digests & np.uint64(15)
            code = coded.indices.to_numpy(zero_copy_only=False)
            for i in range(0, min(dims, 32), 2):
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(pairs[:, i // 2][code], dtype=np.uint64)])
                both = np.diff(before[bounds - bounds[0]])
                out[at:at + len(part), i] = both >> np.uint64(32)
                if i + 1 < dims:
                    out[at:at + len(part), i + 1] = both & np.uint64(0xFFFFFFFF)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
    return sums


class JaccardScorer:
    def __init__(self, pattern: str = WORD_2PLUS):
        self.pattern = pattern

    def column(self, query: Column, content: Column) -> Column:
        a, b = word_tokens(query, self.pattern), word_tokens(content, self.pattern)
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


class WordsGenerator:
    def column(self, prompt: Column) -> Column:
        words = F.filter(F.split(F.coalesce(prompt, F.lit("")), WHITESPACE), lambda w: w != "")
        return F.array(F.array_join(words, " "))


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------

def _applied(model, return_type, batch_size: int):
    """A model as a function of Columns: its expression, or a batch UDF."""
    if hasattr(model, "column"):
        return model.column
    return predict_batch_udf(model, return_type=return_type, batch_size=batch_size)


def encoder_udf(make_predict_fn, batch_size: int = BATCH_SIZE):
    return _applied(make_predict_fn, ArrayType(FloatType()), batch_size)


def embed_documents(documents: DataFrame, make_predict_fn, batch_size: int = BATCH_SIZE,
                    keep: Sequence[str] = (), corpus: DataFrame | None = None,
                    within: str | None = None) -> DataFrame:
    """(doc_id, embedding) and the ``keep`` columns; NULL content is
    encoded as '' (O11).

    An encoder whose vectors need statistics of a table has ``embed_documents``
    and ``embed_queries`` of its own, table in and table out; it takes them from
    ``corpus`` (default: ``documents``), or from the rows that share ``within``."""
    if hasattr(make_predict_fn, "embed_documents"):
        out = make_predict_fn.embed_documents(documents, corpus=corpus, within=within)
        return documents.select("doc_id", *keep).join(out, "doc_id") if keep else out
    enc = encoder_udf(make_predict_fn, batch_size)
    return documents.select("doc_id", *keep, enc(null_to_empty("content")).alias("embedding"))


def embed_queries(queries: DataFrame, make_predict_fn, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(query_id, embedding, top_k)."""
    if hasattr(make_predict_fn, "embed_queries"):
        return make_predict_fn.embed_queries(queries).join(queries.select("query_id", "top_k"), "query_id")
    enc = encoder_udf(make_predict_fn, batch_size)
    return queries.select("query_id", enc(null_to_empty("query")).alias("embedding"), "top_k")


def pair_scores(pairs: DataFrame, make_predict_fn, query_col: str = "query",
                content_col: str = "content", batch_size: int = BATCH_SIZE) -> Column:
    """A similarity Column for each (query, content) row of ``pairs``."""
    scorer = _applied(make_predict_fn, DoubleType(), batch_size)
    return scorer(null_to_empty(query_col), null_to_empty(content_col))


def generate_hypotheses(queries: DataFrame, make_predict_fn, batch_size: int = BATCH_SIZE) -> DataFrame:
    """O52 + O63 + O64: prompt each question, generate replies, one row per
    reply: (query_id, n, text)."""
    gen = _applied(make_predict_fn, ArrayType(StringType()), batch_size)
    replies = queries.select("query_id", gen(render_prompt("query")).alias("replies"))
    return replies.select("query_id", F.posexplode("replies").alias("n", "text")).select(
        "query_id", F.col("n").cast("int").alias("n"), "text")

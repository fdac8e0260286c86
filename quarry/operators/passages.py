"""Documents that contain a passage verbatim, without a cross join.

If a passage occurs in a text, its *interior* words (all but the first and
last, which may be cut mid-word) are whole, consecutive words of the text.
So the first up-to-8 interior words form an anchor that is an equi-join key
against the text's word shingles of the same length, which are hashed in
blocks of texts inside the tasks. Candidates are then
verified with an exact ``instr`` on the whole texts, so the result is exact;
the anchor only decides which pairs are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quarry.functions.text import WORD_1PLUS, explode_values
from quarry.functions.words import source_slices, word_lists, words_source
from quarry.plans.joins import (DEFAULT_BROADCAST_ROWS, is_bounded, join_small_to_big, lookup_join,
                                salted_hot_join)
from quarry.session import shared_dir

ANCHOR_WORDS = 8
# Words of an anchor that are looked up one by one before its key is taken.
HEAD_WORDS = 3
ANCHOR_FIELDS = [StructField("anchor_len", IntegerType()), StructField("anchor_key", LongType())]
# Passages of one or two words looked for in one scan of the texts, about.
SHORT_BLOCK = 1_000


def _words(c: str):
    return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(WORD_1PLUS), 0)


def _hashed(words: pa.ListArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The 64-bit hash of each distinct word, and which one each word is."""
    coded = words.flatten().dictionary_encode()
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False), coded


def _window_keys(hashes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """The key of the ``length`` words from each place ``first`` on."""
    total = np.full(len(first), length, np.uint64)
    for j in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (hashes[first + j] ^ (hashes[first + j] >> np.uint64(29)))
    return total.view(np.int64)


def passage_anchors(passages: DataFrame, max_words: int = ANCHOR_WORDS) -> DataFrame:
    """(query_id, anchor_len, anchor_key, heads) for passages with 3+ words; ``heads``
    are the hashes of the anchor's first words."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w")
            each, coded = _hashed(words)
            hashes = each[coded.indices.to_numpy(zero_copy_only=False)]
            starts, sizes = words.offsets.to_numpy()[:-1], np.diff(words.offsets.to_numpy())
            starts = starts - starts[0] if len(starts) else starts
            keys = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes).tolist():
                keys[sizes == n] = _window_keys(hashes, starts[sizes == n], n)
            heads = [hashes[a:a + min(n, HEAD_WORDS)].view(np.int64) for a, n in zip(starts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(sizes.astype(np.int32)), pa.array(keys),
                 pa.array(heads, pa.list_(pa.int64()))], ["query_id", "anchor_len", "anchor_key", "heads"])

    w = _words("passage")
    n = F.least(F.size(w) - 2, F.lit(max_words))
    anchors = passages.select("query_id", w.alias("w"), n.alias("n")).filter(F.col("n") >= 1)
    schema = StructType([passages.schema["query_id"], *ANCHOR_FIELDS, StructField("heads", ArrayType(LongType()))])
    return anchors.select("query_id", F.slice("w", 2, F.col("n")).alias("w")).mapInArrow(
        keyed, schema)


def _anchor_index(keys: list) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """{length: (the first words' hashes by place, the keys)} of rows (length, key, heads)."""
    out = {}
    for n in sorted({row["anchor_len"] for row in keys}):
        some = [row for row in keys if row["anchor_len"] == n]
        places = zip(*(row["heads"] for row in some), strict=True)
        out[n] = [np.array(p, np.int64).view(np.uint64) for p in places], np.array([row["anchor_key"] for row in some])
    return out


def _shingles(documents: DataFrame, lengths: list[int], wanted=None) -> DataFrame:
    """(doc_id, anchor_len, anchor_key): a document's word shingles of these lengths;
    with ``wanted`` (a broadcast ``_anchor_index``) only those that are an anchor's."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in source_slices(batch.column("w")):
                yield from _shingle_rows(batch.column("doc_id").slice(at, len(part)), word_lists(part, WORD_1PLUS),
                                         lengths, wanted.value if wanted is not None else None)

    schema = StructType([documents.schema["doc_id"], *ANCHOR_FIELDS])
    words = words_source(F.coalesce("content", F.lit("")), WORD_1PLUS)
    return documents.select("doc_id", words.alias("w")).mapInArrow(keyed, schema)


def _shingle_rows(ids: pa.Array, words: pa.ListArray, lengths: list[int],
                  wanted: dict | None) -> Iterator[pa.RecordBatch]:
    each, coded = _hashed(words)
    code = coded.indices.to_numpy(zero_copy_only=False)
    hashes, sizes = each[code], np.diff(words.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))     # words from here to the document's end
    for n in lengths:
        first = np.flatnonzero(left >= n)
        if wanted is not None:
            heads, keys = wanted[n]
            for j, place in enumerate(heads):
                first = first[np.isin(each, place)[code[first + j]]]
        found = _window_keys(hashes, first, n)
        if wanted is not None:
            same = np.isin(found, keys)
            first, found = first[same], found[same]
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row[first])), pa.array(np.full(len(first), n, np.int32)),
                 pa.array(found)], ["doc_id", "anchor_len", "anchor_key"])


def containing_documents(documents: DataFrame, passages: DataFrame,
                         max_words: int = ANCHOR_WORDS,
                         max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(query_id, doc_id) for every document whose content contains the passage.

    documents: (doc_id, content); passages: (query_id, passage)."""
    shared_dir(documents.sparkSession)
    anchors = passage_anchors(passages, max_words).checkpoint()
    # Anchor lengths are 1..max_words: a bounded list.
    lengths = sorted(r[0] for r in anchors.select("anchor_len").distinct().collect())
    short = _short_passages(documents, passages, max_broadcast_rows)
    if not lengths:
        return short
    if is_bounded(anchors, max_broadcast_rows):
        # Proven bounded: the anchors go to the texts, which are read once for all lengths.
        keys = anchors.select("anchor_len", "anchor_key", "heads").distinct().collect()
        wanted = documents.sparkSession.sparkContext.broadcast(_anchor_index(keys))
        hits = _shingles(documents, lengths, wanted).join(
            F.broadcast(anchors.drop("heads")), ["anchor_len", "anchor_key"])
    else:
        # A repeated line makes one shingle key hot on the text side, and
        # copies of a passage make it hot on the passage side: salt it.
        keyed = _shingles(documents, lengths).withColumn("k", F.struct("anchor_len", "anchor_key"))
        akeyed = anchors.withColumn("k", F.struct("anchor_len", "anchor_key")).select("k", "query_id")
        hits = salted_hot_join(keyed.select("k", "doc_id"), akeyed, "k", salt_from=["doc_id"])
    candidates = hits.select("query_id", "doc_id").distinct().checkpoint()
    # A passage found in many copies makes its query_id hot: the passage side
    # has one row per query, so it is a lookup (broadcast when bounded).
    texts = lookup_join(candidates, passages.select("query_id", "passage"), "query_id",
                        max_broadcast_rows=max_broadcast_rows)
    # The candidates are few next to the corpus: broadcast them into the
    # document scan when bounded, so the texts are verified where they lie.
    return (join_small_to_big(texts, documents.select("doc_id", "content"), "doc_id",
                              max_rows=max_broadcast_rows)
            .filter(F.col("content").contains(F.col("passage")))
            .select("query_id", "doc_id")
            .unionByName(short))


def _short_passages(documents: DataFrame, passages: DataFrame, max_rows: int) -> DataFrame:
    """Documents that hold a passage of under three words. Its words may be cut
    on both sides, so no whole word can be a join key; the texts are scanned
    with the passages in blocks of at most ``SHORT_BLOCK`` (a list inside the
    scan, no join)."""
    n = F.size(_words("passage"))
    short = passages.filter((n < 3) & F.col("passage").isNotNull()).select("query_id", "passage")
    rows = short.count()
    blocks = -(-rows // SHORT_BLOCK)
    out = documents.sparkSession.createDataFrame([], StructType([
        passages.schema["query_id"], documents.schema["doc_id"]]))
    for b in range(blocks):
        part = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        listed = part.agg(F.collect_list(F.struct("query_id", "passage"))).scalar()
        held = F.filter("_listed", lambda p: F.contains(F.col("content"), p["passage"]))
        scan = documents.select("doc_id", "content").withColumn("_listed", listed)
        out = out.unionByName(explode_values(scan, held, "p", keep=["doc_id"])
                              .select("p.query_id", "doc_id"))
    return out

"""Operator 10: benchmark items inside documents, by MinHash containment.

An item is found in a document when the document holds at least 3 of 4 of the
item's distinct 5-word shingles (an item of fewer words is one shingle, looked
for among the document's shingles of that many words).

Items are partitioned by size (powers of two of their shingle counts). An
item's sketch is its lowest ``m`` shingle hashes. At containment 0.75 at most
``d = s - ceil(0.75 s)`` of its s shingles are missing, so with m = 2 d + 1 at
least m - d of the sketch occur in every document that holds the item: the
sketch never misses one. A document, however long, is only looked at below the
partition's largest sketch value. What passes is verified by exact shingle
containment on the words themselves.

Items travel to the tasks in blocks of a bounded size, each block one pass over
the documents; there is no shuffle, no join and no group.

Defined cases: items and documents without words match nothing; rows that
repeat an item or a document are each matched on their own; null ids are kept;
empty tables give no rows; other columns are ignored by ``find_items`` and kept
by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import lean, read_table, text_slices
from quarry.llm.shingles import K, distinct_sets, shingle_hashes, spelt_shingles, words_of

#: Containment as a fraction.
SHARE = (3, 4)
#: Item text bytes in one block, about.
BLOCK_BYTES = 16 << 20
MATCHES = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class ItemIndex:
    """The sketches of one block of items, for any number of documents."""

    def __init__(self, items: list[tuple[int | None, str | None]], share: tuple[int, int] = SHARE, k: int = K):
        self.share, self.k = share, k
        self.items = [(i, words_of(t)) for i, t in items]
        self.spelt = [spelt_shingles(w, k) for _, w in self.items]
        sets = distinct_sets(pa.array([t for _, t in items], pa.string()), k)
        # (words in a shingle, size class) -> sketch entries (hash, item)
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.least = np.zeros(len(items), np.int64)
        for no, s in enumerate(sets):
            if not len(s):
                continue
            missing = len(s) - self._needed(len(s))
            sketch = s[:2 * missing + 1]
            self.least[no] = len(sketch) - missing
            part = parts.setdefault((min(len(self.items[no][1]), k), len(s).bit_length()), [])
            part += [(int(h), no) for h in sketch]
        self.parts = []
        for (width, _), entries in sorted(parts.items()):
            entries.sort()
            hashes, first = np.unique(np.array([h for h, _ in entries], np.uint64), return_index=True)
            self.parts.append((width, hashes, np.append(first, len(entries)),
                               np.array([no for _, no in entries], np.int64)))

    def _needed(self, size: int) -> int:
        up, down = self.share
        return -(-up * size // down)

    def candidates(self, texts: pa.Array) -> np.ndarray:
        """(row, item) pairs whose sketch hits suffice, as an n x 2 array."""
        out = [np.zeros((0, 2), np.int64)]
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width, hashes, first, item in self.parts:
            if width not in by_width:
                flat, counts = shingle_hashes(texts, width)
                by_width[width] = flat, np.repeat(np.arange(len(counts)), counts)
            flat, row = by_width[width]
            low = np.flatnonzero(flat <= hashes[-1])
            at = np.searchsorted(hashes, flat[low])
            hit = hashes[at] == flat[low]
            pairs = np.unique(np.stack([row[low][hit], at[hit]], 1), axis=0)
            each = np.diff(first)[pairs[:, 1]]
            entry = np.repeat(first[pairs[:, 1]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            found, hits = np.unique(np.stack([np.repeat(pairs[:, 0], each), item[entry]], 1), axis=0,
                                    return_counts=True)
            out.append(found[hits >= self.least[found[:, 1]]])
        return np.concatenate(out)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item number, shared shingles), verified on the words."""
        spelt: dict[tuple[int, int], set[bytes]] = {}
        at = None
        for row, no in sorted(map(tuple, self.candidates(texts).tolist())):
            if row != at:
                spelt, at, words = {}, row, words_of(texts[row].as_py())
            width = min(len(self.items[no][1]), self.k)
            if width not in spelt:
                spelt[width] = spelt_shingles(words, width)
            shared = len(self.spelt[no] & spelt[width])
            if shared >= self._needed(len(self.spelt[no])):
                yield row, no, shared


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items (item_id, text) in blocks of about ``block_bytes`` of text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def find_items(docs: DataFrame, items: DataFrame, share: tuple[int, int] = SHARE,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment): every document
    that holds an item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for block in item_blocks(items, block_bytes):
        shared_index = spark.sparkContext.broadcast(ItemIndex(block, share))

        def search(batches: Iterator[pa.RecordBatch], b=shared_index) -> Iterator[pa.RecordBatch]:
            index = b.value
            for batch in batches:
                for part in text_slices(batch, "text"):
                    found = list(index.matches(part.column("text")))
                    size = [len(index.spelt[no]) for _, no, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64())),
                         pa.array([index.items[no][0] for _, no, _ in found], pa.int64()),
                         pa.array(size, pa.int64()), pa.array([n for _, _, n in found], pa.int64()),
                         pa.array([n / s for (_, _, n), s in zip(found, size, strict=True)], pa.float64())],
                        ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])
        out = out.unionByName(docs.mapInArrow(lean(search), MATCHES))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, share: tuple[int, int] = SHARE,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns kept."""
    for block in item_blocks(items, block_bytes):
        shared_index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, share))

        def keep(batches: Iterator[pa.RecordBatch], b=shared_index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r for r, _, _ in b.value.matches(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))
        docs = docs.mapInArrow(lean(keep), docs.schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
),
items AS (
  SELECT DISTINCT id, least(len(w), 5) AS k, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE side = 'i' AND len(w) > 0
),
docs AS (
  SELECT DISTINCT id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE side = 'd' AND len(w) > 0
),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS m FROM docs d JOIN items i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, m AS n_shared, m / n AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE 4 * m >= 3 * n
"""

"""Operator 7: best-fit packing with certified bin counts.

Documents become token ids plus an end id; only documents longer than a
sequence are cut. Full pieces are sequences by themselves. The other pieces are
dealt to partitions of a bounded size, and each partition

1. packs them by best-fit decreasing,
2. computes a lower bound on its bins from dual-feasible functions (the
   threshold functions of Martello and Toth's L2 and the rounding functions of
   Fekete and Schepers, both maximised over their parameter),
3. is certified optimal when the two agree.

Partitions with a gap keep their full bins and put the documents of the others
into an exchange pool; certified ones add their emptiest bin, the remainder that
rounding up leaves in each partition. The pool is dealt anew to fewer partitions
and repacked, until one partition holds all of it or it no longer shrinks.

Only (piece_id, length) rows take part; token ids stay in the piece files.

Defined cases: a null or empty text is its end id alone; rows that share a
doc_id are separate documents; an empty table gives no rows. Ties in length
are packed in piece order, so a rerun gives the same plan.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_BYTES, TEXT_BATCH_ROWS, lean, list_column, pinned, read_table, text_slices
from quarry.llm.token_files import ids_crc32
from quarry.llm.tokens import with_end, word_tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
#: Pieces one packing task holds (a few dozen bytes each).
PARTITION_PIECES = 50_000
#: Rounds go on while the exchange pool loses this share of its documents or more.
SHRINK = 1 / 4
PIECES = "piece_id long, doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"
PLAN = "piece_id long, length int, bin int, offset long, bound int, bins int, keep boolean, part long"


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID,
               capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts and cut the documents longer than ``capacity``.

    A piece's digest is taken where its ids are, so they are not read again for it.
    ``piece_id`` numbers the pieces within their task; pin the result before
    use, so that every later read sees the same numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, next_id = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                ids, counts = with_end(*words.encode(part.column("text")), end_id)
                per_doc = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), per_doc)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(next_id + np.arange(len(row)), pa.int64()),
                     part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     list_column(ids.astype(np.int32), length, pa.int32()),
                     pa.array(ids_crc32(ids, np.append(0, np.cumsum(length))), pa.int64())],
                    ["piece_id", "doc_id", "piece", "start", "length", "ids", "ids_crc32"])
                next_id += len(row)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(cut), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and each bin's free room.

    ``rooms`` has bit r set when some open bin has room r, so the tightest bin
    that takes an item is the lowest set bit at or above its length."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - size
        if not open_bins[left]:
            rooms |= 1 << left
        open_bins[left].append(b)
    return bins, offsets, np.array(free, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from dual-feasible functions over the
    number of items of each length (``counts[length]``)."""
    size = np.arange(capacity + 1)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    # Threshold t: items over C - t fill a bin, items under t count nothing.
    number, weight = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    # Rounding functions with k parts; values are kept whole by a factor k * C.
    for k in range(1, 64):
        parts = (k + 1) * size
        whole = parts % capacity == 0
        scaled = np.where(whole, k * size, (parts // capacity) * capacity)  # times 1 / (k * C)
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def _pack_partition(capacity: int, last: bool):
    def pack(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by("piece_id")
        lengths = items.column("length").to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if last:
            keep = np.ones(len(bins), bool)
        elif len(free) == bound:  # certified: only the emptiest bin, the rounding remainder, goes on
            keep = bins != free.argmax()
        else:
            keep = free[bins] == 0
        n = len(lengths)
        return pa.table({
            "piece_id": items.column("piece_id"), "length": lengths.astype(np.int32),
            "bin": bins.astype(np.int32), "offset": offsets, "bound": np.full(n, bound, np.int32),
            "bins": np.full(n, len(free), np.int32), "keep": keep, "part": pa.repeat(key[0], n)})
    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """(piece_id, sequence_id, offset) for every row of pinned ``pieces``.

    Rounds end when one partition holds the pool, or when an exchange no longer
    shrinks it by a quarter (so there are at most log4/3 of its size)."""
    full = pieces.filter(F.col("length") == capacity).select(
        "piece_id", F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.col("piece_id")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    pool = pieces.filter(F.col("length") < capacity).select("piece_id", F.col("length").cast("int").alias("length"))
    done, before = [full], None
    for round_no in itertools.count():
        n = pool.count()
        if n == 0:
            break
        groups = -(-n // partition_pieces)
        last = groups == 1 or (before is not None and n > (1 - SHRINK) * before)
        # A fresh seed each round: documents of different partitions meet.
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("piece_id", F.lit(round_no)), F.lit(groups)))
        plan = pinned(dealt.groupBy("part").applyInArrow(_pack_partition(capacity, last), PLAN), f"pack_{round_no}")
        done.append(plan.filter("keep").select(
            "piece_id", (F.shiftleft(F.lit(round_no).cast("long"), 56)
                         + F.shiftleft(F.col("part"), 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        pool, before = plan.filter("NOT keep").select("piece_id", "length"), n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packed_pieces(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces (with their ids) and their place: sequence_id, offset."""
    return pieces.join(pack(pieces, capacity, **options), "piece_id")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pack whole documents; one row per piece with its ids' digest and place."""
    pieces = pinned(cut_pieces(docs), "pieces", TEXT_BATCH_ROWS)
    return pieces.drop("ids").join(pack(pieces), "piece_id").drop("piece_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))

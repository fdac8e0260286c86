"""Operator 13: periodic runs of words, found in tiles and stitched.

A run is a maximal stretch of words with smallest period q whose length is at
least ``max(12, 2 q)``. Periods are taken by octaves (1 to 7, then 8 to 15, 16
to 31, ...). For each octave a document is laid out in overlapping tiles around
boundaries that lie at most one period apart, so every run has a boundary b
with its first period behind it, words b to b + q.

1. Each tile is solved by itself: its boundary Z-functions say, for every
   period of the octave at once, how many words after b repeat q further on and
   how many words before b do, as far as the tile reaches. Where both together
   make a run, and the period's block is no power of a shorter one, the tile
   gives a fragment (document, period, interval). A task holds whole documents
   and joins touching fragments of its own tiles before they are sent.
2. Fragments meet by (document, period) in one shuffle and are stitched: those
   that touch are one interval. Of equal intervals the smallest period stays.
3. A document's runs go back to its text, where all words after a run's first
   period are dropped.

The Z-functions are evaluated with rolling hashes (two bases) by binary lifting,
for all tiles of a batch at once; each fragment is then compared word by word,
so a hash alone never makes a run.

Words are maximal runs outside ASCII white space, compared byte for byte.
``repeat_plan`` may lay a repetition over a document first (see there).

Defined cases: null, empty and blank texts have no words and no runs; rows that
share an id are found apart by their text, and equal rows get equal results; a
null id is kept and its text is taken as it is; an empty table gives no rows;
other columns are ignored. A text of any length is taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import at_most, join_null_safe, pinned, read_table, text_slices

#: Least words of a run.
LEAST = 12
#: Periods below this one form the first octave; its boundaries lie GRID apart.
FIRST, GRID = 8, 4
#: (boundary, period) pairs looked at together.
CHUNK = 1 << 20
#: Runs that may be broadcast to the texts (three numbers each); beyond it the
#: texts are shuffled to them.
BROADCAST_RUNS = 500_000
FRAGMENTS = "doc_id long, text_hash long, period long, low long, high long"
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long")

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (np.uint64(1_234_567_891), np.uint64(987_654_323))


def repeat_plan(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) when the words from a on are to become a repetition of period p."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def no_plan(doc_id: int | None, n: int) -> None:
    """Every document as it is."""


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1] * base % _PRIME) % _PRIME])
    return out[:n]


class Sequence:
    """Word numbers of several documents end to end, each document between
    numbers that occur nowhere else, so that nothing repeats across documents."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        own = int(words.max(initial=0)) + 1
        ends = np.cumsum(counts)
        self.start = np.concatenate([[0], ends[:-1]]) + np.arange(len(counts)) + 1
        self.seq = np.insert(words.astype(np.int64), np.concatenate([[0], ends]), own + np.arange(len(counts) + 1))
        self.n = len(self.seq)
        self.doc = np.searchsorted(self.start, np.arange(self.n), side="right") - 1
        self.room = np.where(self.doc >= 0, counts[self.doc], 0)
        self.longest = int(counts.max(initial=0))
        self.hashes = []
        for base in _BASES:
            power = _powers(base, self.n + 1)
            sums = np.cumsum((self.seq + 1).astype(np.uint64) * power[:-1] % _PRIME)
            self.hashes.append((np.concatenate([[np.uint64(0)], sums]) % _PRIME, power))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a on are those from b on (a <= b, in range)."""
        out = np.ones(len(a), bool)
        for sums, power in self.hashes:
            left = (sums[a + size] + _PRIME - sums[a]) % _PRIME * power[b - a] % _PRIME
            out &= left == (sums[b + size] + _PRIME - sums[b]) % _PRIME
        return out

    def extent(self, a: np.ndarray, b: np.ndarray, reach: int, back: bool) -> np.ndarray:
        """The Z-function's values: how many words from a on (or before a) equal
        those at b, up to the tile's reach."""
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, reach - 1).bit_length()
        while step:
            at, to = (a - got - step, b - got - step) if back else (a + got, b + got)
            fits = np.flatnonzero(at >= 0 if back else to + step <= self.n)
            hit = fits[self.same(at[fits], to[fits], np.int64(step))]
            got[hit] += step
            step >>= 1
        return got

    def power_of_less(self, b: np.ndarray, q: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Whether the block of q words from b on is a power of a shorter one."""
        out = np.zeros(len(b), bool)
        rest = q.copy()
        live = np.flatnonzero(rest > 1)
        while len(live):
            p = factor[rest[live]]
            d = q[live] // p
            out[live] |= self.same(b[live], b[live] + d, q[live] - d)
            rest[live] //= p
            live = live[(rest[live] > 1) & ~out[live]]
        return out


def _first_octave(s: Sequence) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    grid = np.arange(GRID, s.n, GRID)
    grid = grid[s.room[grid] >= LEAST]
    for q in range(1, FIRST):
        b = grid[grid + q < s.n]
        near = (s.seq[b] == s.seq[b + q]) | (s.seq[b - 1] == s.seq[b - 1 + q])
        yield b[near], np.full(int(near.sum()), q)


def _octave(s: Sequence, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Boundaries b (multiples of ``low``) and periods low to 2 low - 1 where a
    word beside the boundary repeats; tiles are compared as rows of a matrix."""
    rows = -(-s.n // low) + 1
    width = rows * low
    ahead = np.full(width, -1, np.int64)
    ahead[:s.n] = s.seq
    behind = np.full(width, -2, np.int64)
    behind[1:s.n + 1] = s.seq[:width - 1]
    ahead, behind = ahead.reshape(rows, low), behind.reshape(rows, low)
    tiles = np.flatnonzero(s.room[np.arange(0, s.n, low)] >= 2 * low)
    tiles = tiles[tiles + 1 < rows]
    per_chunk = max(1, CHUNK // low)
    for at in range(0, len(tiles), per_chunk):
        t = tiles[at:at + per_chunk]
        near = (ahead[t + 1] == ahead[t, :1]) | (behind[t + 1] == behind[t, :1])
        row, col = np.nonzero(near)
        yield t[row] * low, low + col


def _smallest_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n ** 0.5) + 1):
        if out[p] == p:
            multiples = out[p * p::p]
            multiples[multiples == np.arange(p * p, n + 1, p)] = p
    return out


def _exact(seq: np.ndarray, b: int, q: int) -> tuple[int, int]:
    """The interval around b in which words repeat q further on, word by word."""
    low = high = b
    while seq[high] == seq[high + q]:
        high += 1
    while seq[low - 1] == seq[low - 1 + q]:
        low -= 1
    return low, high


def fragments(s: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, low, high): intervals in which words repeat one period
    further on, touching ones joined; all documents of the sequence at once."""
    found = [np.zeros((0, 3), np.int64)]
    factor = _smallest_factors(max(2, s.longest))
    low = 1
    while 2 * low <= s.longest:
        octave = _first_octave(s) if low < FIRST else _octave(s, low)
        reach = 2 * max(low, FIRST)
        for b, q in octave:
            need = np.maximum(q, LEAST - q)
            half = (need + 1) // 2
            # One side of the boundary has at least half of what a run needs.
            fits = b + q + half <= s.n
            right = np.zeros(len(b), bool)
            right[fits] = s.same(b[fits], b[fits] + q[fits], half[fits])
            fits = ~right & (b >= half)
            right[fits] = s.same(b[fits] - half[fits], b[fits] + q[fits] - half[fits], half[fits])
            b, q, need = b[right], q[right], need[right]
            whole = ~s.power_of_less(b, q, factor)
            b, q, need = b[whole], q[whole], need[whole]
            after, before = s.extent(b, b + q, reach, False), s.extent(b, b + q, reach, True)
            run = after + before >= need
            b, q, after, before = b[run], q[run], after[run], before[run]
            found.append(np.stack([q, b - before, b + after], 1))
            for i in range(len(b)):
                lo, hi = int(b[i] - before[i]), int(b[i] + after[i])
                if not np.array_equal(s.seq[lo:hi], s.seq[lo + q[i]:hi + q[i]]):
                    found[-1][i, 1:] = _exact(s.seq, int(b[i]), int(q[i]))
        low = FIRST if low < FIRST else 2 * low
    q, lo, hi = np.concatenate(found).T
    order = np.lexsort((hi, lo, q, s.doc[lo]))
    q, lo, hi = q[order], lo[order], hi[order]
    doc = s.doc[lo]
    # Inside a document and period, ends grow with starts (boundaries do).
    new = np.ones(len(q), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (q[1:] != q[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    top = np.maximum.reduceat(hi, at) if len(at) else hi
    return doc[at], q[at], lo[at] - s.start[doc[at]], top - s.start[doc[at]]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, words per text), numbers by distinct word."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    bounds = lists.offsets.to_numpy()
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    kept = np.concatenate([[0], np.cumsum(real)])
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return numbers[real].astype(np.int64), np.diff(kept[bounds - bounds[0]])


def _repeated(words: np.ndarray, ids: list, counts: np.ndarray, plan: Callable) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    for doc_id, start, n in zip(ids, starts.tolist(), counts.tolist(), strict=True):
        if laid := plan(doc_id, n):
            a, p = laid
            words[start + a:start + n] = words[start + a + np.arange(n - a) % p]
    return words


def _solve_tiles(plan: Callable):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, counts = _numbered(part.column("text"))
                words = _repeated(words, part.column("doc_id").to_pylist(), counts, plan)
                doc, q, low, high = fragments(Sequence(words, counts))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("text_hash").take(rows), pa.array(q),
                     pa.array(low), pa.array(high)], ["doc_id", "text_hash", "period", "low", "high"])
    return solve


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def stitch(pieces: DataFrame, least: int = LEAST) -> DataFrame:
    """Fragments (key columns, period, low, high) -> runs (key columns, start, length, period)."""
    key = [c for c in pieces.columns if c not in ("period", "low", "high")]
    in_order = Window.partitionBy(*key, "period").orderBy("low", "high")
    before = F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col("low") <= F.col("before"), 0).otherwise(1)
    pieces = pieces.distinct().withColumn("before", before).withColumn("island", F.sum(cut).over(in_order))
    runs = pieces.groupBy(*key, "period", "island").agg(
        F.min("low").alias("start"), (F.max("high") + F.col("period") - F.min("low")).alias("length"))
    runs = runs.filter((F.col("length") >= least) & (F.col("length") >= 2 * F.col("period")))
    return runs.groupBy(*key, "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, plan: Callable = no_plan) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, text_hash, start, length, period): one row per run."""
    return stitch(_keyed(docs).mapInArrow(_solve_tiles(plan), FRAGMENTS))


def _collapse(plan: Callable):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for doc_id, text, runs in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(),
                                              part.column("runs").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    n = len(words)
                    if laid := plan(doc_id, n):
                        a, p = laid
                        words[a:] = [words[a + i % p] for i in range(n - a)]
                    spans = [(r["start"], r["length"], r["period"]) for r in runs or []]
                    if spans:
                        keep = np.ones(n, bool)
                        for start, length, period in spans:
                            keep[start + period:start + length] = False
                        words = [words[i] for i in np.flatnonzero(keep)]
                    best = min(spans, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    said = "".join(f"{s},{k},{q}\n" for s, k, q in spans)
                    out.append({"doc_id": doc_id, "n_runs": len(spans),
                                **dict(zip(("start", "length", "period"), best or (None,) * 3, strict=True)),
                                "exponent_milli": 1000 * best[1] // best[2] if best else None,
                                "runs_sha256": hashlib.sha256(said.encode()).hexdigest(),
                                "collapsed_sha256": hashlib.sha256(b" ".join(words)).hexdigest(),
                                "n_words": n, "n_kept": len(words)})
                yield pa.RecordBatch.from_pylist(out, schema=_RESULT_ARROW)
    return collapse


_RESULT_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64())
                           for c in RESULT.split(", ")])


def collapse_runs(docs: DataFrame, plan: Callable = no_plan) -> DataFrame:
    """One row per document: its number of runs, the longest run, and digests of
    all runs and of the text without their repetitions."""
    key = ["doc_id", "text_hash"]
    runs = pinned(periodic_runs(docs, plan), "periodic_runs")
    each = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    if at_most(runs, BROADCAST_RUNS):
        each = F.broadcast(each)
    texts = join_null_safe(_keyed(docs), each, key, "left").select("doc_id", "text", "runs")
    return texts.mapInArrow(_collapse(plan), RESULT)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(read_table(spark, sf_dir, "documents"), repeat_plan)

"""Operator 11: document fingerprints from spot signatures.

A spot signature is a common word (the anchor) and the chain of the content
words that follow it, common words between them skipped. A document's
fingerprint is the set of its signatures, 48-bit hashes in ascending order.
Layout words around a text that hold no sentence leave no signatures, and an
edit touches only the few chains that run through it.

* ``signature_sets`` reads a batch of whole texts at once.
* ``likeness`` compares pairs of fingerprints: pairs are partitioned by set
  length; two sizes bound the Jaccard similarity by shorter / longer, so pairs
  that cannot reach ``least`` are pruned before anything is compared, and the
  rest of a partition is intersected together, exactly.
* ``spot_classes`` finds near duplicates of a whole table: documents meet in
  partitions of set length (each also takes part in the next one, where the
  longest set it can match lies) on their rarest signatures, and pairs that the
  length bound or what is left of either set rules out are never compared. It
  runs on the prefix join's rounds, so copies by the thousand are not paired off.
* ``compare_in_order`` puts each document beside the next one in id order: rows
  are dealt once into id ranges, and the first row of each range is also sent
  to the range before it.

Words are runs outside ASCII white space, lower-cased, with marks cut off both
ends. A text that has words but no whole chain has one signature, its word
sequence. The likeness of two fingerprints is 1 when both are empty and 0 when
one is.

Defined cases: null and empty texts have the empty fingerprint; equal texts
have equal fingerprints; rows that share an id are in the order of their text's
hash; null ids come first; the only row of a table is its own successor; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, pinned, read_table, text_slices
from quarry.llm.jaccard_join import jaccard_classes
from quarry.llm.shingles import _mix

# The common words of four languages that serve as anchors.
COMMON_WORDS = (
    "the of and to a in is that for it was on with be as by are this at from "
    "de la le et les des en un une du que pour est qui dans par pas au sur avec "
    "der die und den von zu das sich mit auf für ist im dem nicht ein eine als "
    "el y los se del las por no con su para es al lo como más o pero sus le").split()
CHAIN = 2
HASH_BITS = 48
#: Text bytes of one id range, about; beyond MAX_RANGES the ranges grow.
RANGE_BYTES = 8 << 20
MAX_RANGES = 100_000
#: Sampled keys for each range's bounds.
SAMPLED = 20
LEAST_LONG = -(1 << 63)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_signatures long")


class SpotReader:
    """Signature sets of batches of texts, for one list of anchors."""

    def __init__(self, anchors: Sequence[str] = COMMON_WORDS, chain: int = CHAIN):
        self.chain = chain
        self.anchors = pa.array(sorted(set(anchors)), pa.string())

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted distinct signatures of each text."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        spelt = pc.replace_substring_regex(coded.dictionary, "^[^\\pL\\pN]+|[^\\pL\\pN]+$", "")
        real = pc.binary_length(spelt).to_numpy(zero_copy_only=False) > 0
        common = pc.is_in(spelt, value_set=self.anchors).to_numpy(zero_copy_only=False)
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, spelt.to_numpy(zero_copy_only=False)), np.uint64, len(spelt))
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        keep = real[which]
        which, row = which[keep], row[keep]
        hashes, anchor = each[which], common[which]
        at = np.flatnonzero(anchor)
        content = np.flatnonzero(~anchor)
        first = np.searchsorted(content, at)
        whole = first + self.chain <= len(content)
        at, first = at[whole], first[whole]
        inside = row[content[first + self.chain - 1]] == row[at] if len(at) else np.zeros(0, bool)
        at, first = at[inside], first[inside]
        sums = _mix(hashes[at])
        for j in range(self.chain):
            sums = _mix(sums + hashes[content[first + j]])
        sums >>= np.uint64(64 - HASH_BITS)
        counts = np.bincount(row[at], minlength=len(texts))
        words = np.bincount(row, minlength=len(texts))
        starts = np.cumsum(words) - words
        sets = [np.unique(s) for s in np.split(sums, np.cumsum(counts)[:-1])] if len(texts) else []
        for i in np.flatnonzero((counts == 0) & (words > 0)).tolist():
            whole_text = xxhash.xxh3_64_intdigest(hashes[starts[i]:starts[i] + words[i]].tobytes())
            sets[i] = np.array([whole_text], np.uint64) >> np.uint64(64 - HASH_BITS)
        return sets


signature_sets = SpotReader()


def spelt(signatures: np.ndarray) -> str:
    """A fingerprint as text: 8 base-64 letters for each signature, ascending."""
    raw = signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8:]
    return base64.b64encode(raw.tobytes()).decode()


def likeness(left: list[np.ndarray], right: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard similarity of each pair of sorted distinct sets; 0 where it is
    below ``least``. Pairs are partitioned by the length of the longer set."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    short, long = sizes.min(1), sizes.max(1)
    out = (long == 0).astype(np.float64)
    open_pairs = np.flatnonzero((short > 0) & (short >= least * long))
    part = np.frexp(long[open_pairs])[1]                       # doubling lengths
    for p in np.unique(part):
        pairs = open_pairs[part == p]
        for at in range(0, len(pairs), 1 << (64 - HASH_BITS)):
            some = pairs[at:at + (1 << (64 - HASH_BITS))]
            tag = np.arange(len(some), dtype=np.uint64) << np.uint64(HASH_BITS)
            a = np.concatenate([left[i] | t for i, t in zip(some.tolist(), tag, strict=True)])
            b = np.concatenate([right[i] | t for i, t in zip(some.tolist(), tag, strict=True)])
            met = np.intersect1d(a, b, assume_unique=True) >> np.uint64(HASH_BITS)
            both = np.bincount(met.astype(np.int64), minlength=len(some))
            out[some] = both / (sizes[some].sum(1) - both)
    return np.where(out >= least, out, 0.0)


def spot_classes(docs: DataFrame, anchors: Sequence[str] = COMMON_WORDS, chain: int = CHAIN) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, n_signatures, class_id): documents whose
    fingerprints have a Jaccard similarity of 3/4 or more are linked, and a class
    is named by its smallest doc_id."""
    reader = SpotReader(anchors, chain)

    def spread_sets(texts: pa.Array) -> list[np.ndarray]:
        return [np.sort(_mix(s)) for s in reader(texts)]       # the join wants hashes of 64 bits

    classes = jaccard_classes(docs, spread_sets, by_length=True)
    return classes.select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id"))


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of the id range of (k, h): how many cuts are at most that."""
    if not cuts:
        return F.lit(0)
    ids = F.lit(np.array([c[0] for c in cuts], np.int64))
    hashes = F.lit(np.array([c[1] for c in cuts], np.int64))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def halve(at: Column, step: Column) -> Column:
        def tried(to: Column) -> Column:
            i, h = F.get(ids, to - 1), F.get(hashes, to - 1)
            reached = (to <= len(cuts)) & ((i < F.col("k")) | ((i == F.col("k")) & (h <= F.col("h"))))
            return F.when(reached, to).otherwise(at)
        return let(at + step, tried)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def ranges_with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES, most: int = MAX_RANGES) -> DataFrame:
    """(part, tail, k, doc_id, text): rows sorted by id within whole id ranges;
    a range ends with one row more (tail 1), the first one of the range after it."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)).alias("k"),
                        F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = pinned(keyed.select("k", "h", F.octet_length("text").alias("size")), "range_keys")
    size = keys.agg(F.sum(F.coalesce("size", F.lit(0)).cast("long"))).first()[0] or 0
    ranges = min(most, max(1, -(-size // range_bytes)))
    drawn = keys.select("k", "h").orderBy(F.xxhash64("k", "h"), "k", "h").limit(SAMPLED * ranges).collect()
    drawn = sorted((r["k"], r["h"]) for r in drawn)
    cuts = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else set())
    part = _range_of(cuts)
    firsts = keys.groupBy(part.alias("part")).agg(F.min(F.struct("k", "h")).alias("first")).orderBy("part").collect()
    rows = keyed.select(part.alias("part"), F.lit(0).alias("tail"), "k", "h", "doc_id", "text")
    if not firsts:
        return rows
    ends = docs.sparkSession.createDataFrame(
        [(before["part"], r["first"]["k"], r["first"]["h"]) for before, r in zip([firsts[-1], *firsts], firsts, strict=False)],
        "part int, k long, h long")
    tails = (keyed.join(F.broadcast(ends), ["k", "h"]).groupBy("part", "k", "h")
             .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
             .select("part", F.lit(1).alias("tail"), "k", "h", "doc_id", "text"))
    return (rows.unionByName(tails).repartition(len(cuts) + 1, "part")
            .sortWithinPartitions("part", "tail", "k", "h").drop("h"))


def _compare(reader: SpotReader):
    def rows(part: pa.RecordBatch, held: dict | None) -> Iterator[dict]:
        for row in ([held] if held else []) + part.to_pylist():
            yield row

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set = None, None
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = ([held_set] if held else []) + reader(part.column("text"))
                line = list(rows(part, held))
                pairs = [j for j in range(len(line) - 1) if not line[j]["tail"] and line[j]["part"] == line[j + 1]["part"]]
                held, held_set = line[-1], sets[-1]
                edited = []
                for j in pairs:
                    own, after = line[j]["text"] or "", line[j + 1]["text"] or ""
                    half = len(own) // 2
                    edited.append(own[:len(own) - half] + after[:half])
                own_sets, next_sets = [sets[j] for j in pairs], [sets[j + 1] for j in pairs]
                edited_sets = []
                for some in text_slices(pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], ["text"]), "text"):
                    edited_sets += reader(some.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line[j]["doc_id"] for j in pairs], pa.int64()),
                     pa.array([len(line[j]["text"] or "") for j in pairs], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                     pa.array(map(spelt, own_sets), pa.string()), pa.array(map(spelt, edited_sets), pa.string()),
                     pa.array(likeness(own_sets, edited_sets)), pa.array(likeness(own_sets, next_sets)),
                     pa.array(map(len, own_sets), pa.int64())],
                    [c.split()[0] for c in RESULT.split(", ")])
    return compare


def compare_in_order(docs: DataFrame, anchors: Sequence[str] = COMMON_WORDS, chain: int = CHAIN,
                     range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document's fingerprint, that of its text with the second half taken
    from the next document, and its likeness to that text and to the next document."""
    return ranges_with_next(docs, range_bytes).mapInArrow(_compare(SpotReader(anchors, chain)), RESULT)


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_in_order(read_table(spark, sf_dir, "documents"))

"""Operator 12: spelling variants by a dictionary of trie-node pairs.

Two words are near when one inserted, deleted or replaced code point turns one
into the other. A word's form is the most frequent word near it, if that is
several times as frequent; following forms leads to its root.

1. The words are sorted over the whole table (range partitions) and each gets
   the nodes of its path in the trie of all words: a word shares the nodes of
   its common prefix with the word before it, the rest are new numbers. Where a
   partition begins inside a path of the one before, the few shared nodes are
   renamed. The same is done with the words reversed. Cost and size are linear
   in the letters, also for words of any length.
2. Prefix w[:i] is then one integer and suffix w[j:] another. A word gives the
   pair (w[:i], w[i+1:]) for every skipped position and (w[:i], w[i:]) for every
   place of an insertion. Words whose skipped pairs meet differ in one replaced
   letter; a skipped pair that meets an insertion place is a deletion. Pairs are
   joined as integers; texts are not compared and no candidate is ever wrong.
   A skipped pair meets at most one word per letter of the alphabet, so no key
   of the join is hot. Of equal letters in a row only the first is skipped for a
   deletion, so each near pair is found once.
3. Near words are counted per word and the best one kept (partial aggregates);
   roots follow by pointer doubling until nothing changes.

Word numbers grow with the words' code-point order, so ties need no strings.

Defined cases: null words are dropped; a word given several times counts once,
with the sum of its n; an empty word is near every word of one letter; texts
that are null or empty have no words; a null doc_id loses no letter in
``corpus_words``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import pinned, read_table, text_slices

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is at least this many times as frequent as the word.
RATIO = 10
#: Of the hashes of (document, run), one in so many loses a letter.
TYPO_EVERY = 31
#: Distinct words a counting task holds before it sends them on.
HELD_WORDS = 200_000
RUN = "[A-Za-zÀ-ÿ]"
#: Nodes of one task and trie; the task's number stands above.
NODE_BITS = 40


def with_typo(start: int, run: str, every: int = TYPO_EVERY) -> str:
    """The run as it counts in a document whose id has the checksum ``start``."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def _count_runs(least: int, every: int | None):
    run = re.compile(f"{RUN}{{{least},}}")

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    # bytes.lower() turns A-Z only.
                    found = Counter(run.findall((text or "").encode().lower().decode()))
                    if every is None or doc_id is None:
                        held.update(found)
                        continue
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in found.items():
                        word = with_typo(start, word, every)
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)
    return count


def corpus_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                 typo_every: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts (doc_id, text) with their counts."""
    parts = docs.select("doc_id", "text").mapInArrow(_count_runs(least_letters, typo_every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _number(column: str, keep: list[str]):
    """Trie paths of the sorted strings in ``column``; node 0 is the root."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = (TaskContext.get().partitionId() << NODE_BITS) + 1
        last, path = "", [0]
        for batch in batches:
            paths = []
            for word in batch.column(column).to_pylist():
                same = _shared(last, word)
                new = len(word) - same
                path = path[:same + 1] + list(range(free, free + new))
                free += new
                last = word
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(paths, pa.list_(pa.int64()))],
                                             [*keep, "path"])
    return number


def _renamed(trie: DataFrame, column) -> tuple[np.ndarray, np.ndarray]:
    """(node, the same node's first number) of the nodes that two partitions
    share. Only each partition's first and last path is read here."""
    leaf = F.element_at("path", -1)
    row = F.struct(leaf.alias("leaf"), column.alias("word"), F.col("path"))
    ends = (trie.filter(F.size("path") > 1).groupBy(F.shiftright(leaf, NODE_BITS).alias("task"))
            .agg(F.min(row).alias("first"), F.max(row).alias("last")).orderBy("task").collect())
    names: dict[int, int] = {}
    before = None
    for _, first, last in ends:
        if before is not None:
            same = _shared(before["word"], first["word"])
            for old, new in zip(first["path"][1:same + 1], before["path"][1:same + 1], strict=True):
                names[old] = names.get(new, new)
        before = last
    old = np.array(sorted(names), np.int64)
    return old, np.array([names[i] for i in old.tolist()], np.int64)


def _tries(words: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
    """(word_id, word, n, path) and (word_id, path of the reversed word), pinned,
    and the renamed nodes of both."""
    ahead = pinned(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(
        _number("word", ["word", "n"]), "word string, n long, path array<long>"), "prefix_trie")
    ahead = ahead.withColumn("word_id", F.element_at("path", -1))
    turned = ahead.select("word_id", F.reverse("word").alias("turned"))
    back = pinned(turned.repartitionByRange("turned").sortWithinPartitions("turned").mapInArrow(
        _number("turned", ["word_id", "turned"]), "word_id long, turned string, path array<long>"), "suffix_trie")
    names = _renamed(ahead, F.col("word")), _renamed(back, F.col("turned"))
    return ahead, back.select("word_id", F.col("path").alias("back")), names


def _pairs(names: tuple):
    """Node pairs of each word: place (an insertion may come there), or skip."""
    def canonical(nodes: np.ndarray, renamed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        old, new = renamed
        if not len(old):
            return nodes
        at = np.minimum(np.searchsorted(old, nodes), len(old) - 1)
        return np.where(old[at] == nodes, new[at], nodes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "word", 1 << 18):
                word_id = batch.column("word_id").to_numpy()
                n = batch.column("n").to_numpy()
                ahead = canonical(batch.column("path").flatten().to_numpy(), names[0])
                back = canonical(batch.column("back").flatten().to_numpy(), names[1])
                size = np.diff(batch.column("path").offsets.to_numpy())    # letters + 1
                row = np.repeat(np.arange(len(size)), size)
                first = np.repeat(np.cumsum(size) - size, size)
                i = np.arange(len(row)) - first
                rest = first + size[row] - 1 - i                           # suffix from letter i on
                letters = np.frombuffer("".join(w + "\0" for w in batch.column("word").to_pylist())
                                        .encode("utf-32-le", "surrogatepass"), np.uint32)
                skip = np.flatnonzero(i < size[row] - 1)
                new = (i[skip] == 0) | (letters[skip] != letters[skip - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ahead, ahead[skip]])), pa.array(np.concatenate([back[rest], back[rest[skip] - 1]])),
                     pa.array(np.concatenate([word_id[row], word_id[row[skip]]])),
                     pa.array(np.concatenate([n[row], n[row[skip]]])),
                     pa.array(np.concatenate([np.zeros(len(row), np.int8), 1 + new.astype(np.int8)]))],
                    ["prefix", "suffix", "word_id", "n", "kind"])
    return emit


def _near(ahead: DataFrame, back: DataFrame, names: tuple) -> DataFrame:
    """(word_id, n, near_id, near_n): every near pair, in both directions."""
    rows = pinned(ahead.select("word_id", "word", "n", "path").join(back, "word_id").mapInArrow(
        _pairs(names), "prefix long, suffix long, word_id long, n long, kind byte"), "node_pairs")
    key = ["prefix", "suffix"]
    one = rows.filter("kind > 0").drop("kind")
    two = one.select(*key, F.col("word_id").alias("near_id"), F.col("n").alias("near_n"))
    replaced = one.join(two, key).filter("word_id < near_id").drop(*key)
    place = rows.filter("kind = 0").select(*key, F.col("word_id").alias("near_id"), F.col("n").alias("near_n"))
    deleted = rows.filter("kind = 2").drop("kind").join(place, key).drop(*key)
    found = replaced.unionByName(deleted)
    way = F.struct("word_id", "n", "near_id", "near_n")
    other = F.struct(F.col("near_id").alias("word_id"), F.col("near_n").alias("n"),
                     F.col("word_id").alias("near_id"), F.col("n").alias("near_n"))
    return found.select(F.explode(F.array(way, other)).alias("r")).select("r.*")


def _distinct_words(words: DataFrame) -> DataFrame:
    return words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) -> (word, near): all pairs one edit apart, both ways."""
    ahead, back, names = _tries(_distinct_words(words))
    found = _near(ahead, back, names).select("word_id", "near_id")
    near = ahead.select(F.col("word_id").alias("near_id"), F.col("word").alias("near"))
    return found.join(ahead.select("word_id", "word"), "word_id").join(near, "near_id").select("word", "near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word_id, form_id) -> (word_id, root_id), by pointer doubling to the end."""
    roots = forms.select("word_id", F.col("form_id").alias("root_id"))
    while True:
        step = roots.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next_id"))
        moved = pinned(roots.join(step, "root_id", "left").select(
            "word_id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")),
            "roots")
        roots = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) -> word, form, root, n, n_near, form_n: one row per word."""
    ahead, back, names = _tries(_distinct_words(words))
    best = F.max(F.struct("near_n", (-F.col("near_id")).alias("minus")))
    near = pinned(_near(ahead, back, names).groupBy("word_id", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"))
                  .select("word_id", "n", "n_near", F.col("b.near_n").alias("form_n"), (-F.col("b.minus")).alias("form_id")),
                  "near_words")
    forms = near.filter(F.col("form_n") >= ratio * F.col("n"))
    spelt = ahead.select("word_id", "word")
    named = (forms.select("word_id", "form_id", "form_n").join(_roots(forms), "word_id")
             .join(spelt.select(F.col("word_id").alias("form_id"), F.col("word").alias("form")), "form_id")
             .join(spelt.select(F.col("word_id").alias("root_id"), F.col("word").alias("root")), "root_id")
             .select("word_id", "form", "root", "form_n"))
    return (ahead.select("word_id", "word", "n").join(near.select("word_id", "n_near"), "word_id", "left")
            .join(named, "word_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(read_table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY))

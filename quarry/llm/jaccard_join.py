"""Operator 5: n-gram Jaccard self-join and its components.

Two documents link when the Jaccard similarity of their distinct 5-word shingle
sets is at least 3/4. Shingles are 64-bit hashes; texts are verified whole.

1. One pass over the texts: each document's set size and set signature, and a
   count of shingles per hash bucket (a fixed grid, summed map-side). Equal
   sets form one class; only its smallest id goes on.
2. Rare-first order: shingles are ordered by (bucket count, hash), the same in
   all documents. A document of n shingles can only reach 3/4 with documents
   that share one of its first n - ceil(3n/4) + 1 shingles.
3. Documents meet on those prefix shingles, under the length filter
   (4 * shorter >= 3 * longer) and the positional filter (of the first shingle
   that two documents share, no more can be shared than is left on either side;
   the pair needs one shingle that passes). A shingle is dropped when all its documents have the
   same prefix shingle just before it: they meet there. Distinct pairs then pass the
   suffix filter (sizes of 16 hash ranges bound the overlap) and are verified
   once against the texts.
4. A shingle's documents are not paired off with each other first. In rounds
   each shingle's documents are compared with one pivot of their group, and
   links become components. Only pairs across components are still open; when
   few enough are left (linear in the rows), or a round no longer halves them, they
   are enumerated, all of them, a pair on the first shingles it shares only. No pair
   inside a component can change the result, so no link is lost.

Hot shingles (buckets far over the mean) are told apart when emitted and their
rows dealt over many tasks; later they meet only in aggregates that combine
map-side and in joins that AQE splits.

Defined cases: null, empty and blank texts have no shingles and are alone; rows
that share an id are one document (each row keeps its own n_shingles, they share
the component); rows with a null id take no part and have a null component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import join_null_safe, lean, pinned, read_table, small_side, text_slices
from quarry.llm.components import components
from quarry.llm.shingles import distinct_sets

#: Buckets of the shingle counts: 2**BUCKET_BITS numbers, whatever the corpus.
BUCKET_BITS = 18
#: Bits of a shingle's hash by which documents meet (all links are verified on whole texts).
TOKEN_BITS = 48
#: A shingle is hot when its bucket holds this many times the mean.
HOT = 4
#: Tasks over which the rows of a hot shingle are dealt.
HOT_SALTS = 64
#: Rows of a narrow table that may be broadcast; beyond it a shuffle join.
BROADCAST_ROWS = 500_000
#: The same for pivots with their range sizes (some 100 bytes each).
BROADCAST_PIVOTS = 200_000
#: Open pairs a prefix row that are enumerated at once, and after a pivot round.
#: Above it rounds go on as long as each halves the open pairs.
OPEN_PAIRS_PER_ROW = 0.5
LATER_PAIRS_PER_ROW = 4
#: Open shingles just before a row's own that it carries when pairs are enumerated.
EARLIER = 4
#: Members that one task compares with one copy of a pivot's text, about.
PER_PIVOT = 256
RANGES = 16
#: Keeps a set size that is a whole power of 4/3 on one side of its bound.
LENGTH_SLACK = 1e-9

SetsOf = Callable[[pa.Array], list[np.ndarray]]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _profiler(sets_of: SetsOf):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _profile(batches, sets_of)
    return profile


def _profile(batches: Iterator[pa.RecordBatch], sets_of: SetsOf) -> Iterator[pa.RecordBatch]:
    """Document rows (set size, signature, range sizes) and bucket counts."""
    names = ["doc_id", "text_hash", "n", "sig_a", "sig_b", "ranges", "bucket", "hits"]
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = sets_of(part.column("text"))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            counts += np.bincount(_bucket(flat), minlength=len(counts))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            with np.errstate(over="ignore"):
                sig_a = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                sig_b = [int((s * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            row = np.repeat(np.arange(len(sets)), size)
            ranges = np.bincount(row * RANGES + (flat & np.uint64(RANGES - 1)).astype(np.int64),
                                 minlength=len(sets) * RANGES).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ranges) + 1, RANGES, dtype=np.int32)),
                                             pa.array(ranges))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(size), pa.array(sig_a, pa.int64()),
                 pa.array(sig_b, pa.int64()), lists, none, none], names)
    used = np.flatnonzero(counts)
    none = pa.nulls(len(used), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [none, none, none, none, none, pa.nulls(len(used), pa.list_(pa.int32())), pa.array(used),
         pa.array(counts[used])], names)


def _prefixes(buckets, sets_of: SetsOf) -> object:
    """Prefix rows (token, id, place) of each document, rare first. ``place`` holds n and
    pos, inverted when the shingle is hot; of a hash the first ``TOKEN_BITS`` go on (two
    shingles that agree in them share their bucket; they add candidates and lose none)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = buckets.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = sets_of(part.column("text"))
                tokens = []
                for s in sets:
                    length = len(s) - (3 * len(s) + 3) // 4 + 1 if len(s) else 0
                    # s is sorted by hash, and a stable sort keeps that order in a bucket count.
                    tokens.append(s[np.argsort(counts[_bucket(s)], kind="stable")[:length]])
                size = np.fromiter(map(len, tokens), np.int64, len(tokens))
                flat = np.concatenate([np.zeros(0, np.uint64), *tokens])
                row = np.repeat(np.arange(len(sets)), size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                place = n[row] << 32 | pos
                yield pa.RecordBatch.from_arrays(
                    [pa.array((flat >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)),
                     part.column("doc_id").take(pa.array(row)),
                     pa.array(np.where(counts[_bucket(flat)] > hot, ~place, place))], ["token", "id", "place"])
    return emit


def _similar_size(a: str, b: str) -> Column:
    return (4 * F.col(f"{a}n") >= 3 * F.col(f"{b}n")) & (4 * F.col(f"{b}n") >= 3 * F.col(f"{a}n"))


def _enough(most: Column, a: str, b: str) -> Column:
    """Whether an overlap of ``most`` shingles could reach 3/4."""
    return 7 * most >= 3 * (F.col(f"{a}n") + F.col(f"{b}n"))


def _rest(a: str, b: str) -> Column:
    """Shingles that two documents can share from this one on."""
    return F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))


def _verifier(sets_of: SetsOf):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, sets_of)
    return verify


def _verify(batches: Iterator[pa.RecordBatch], sets_of: SetsOf) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, salt), the pivot's own text first (a null): links."""
    # Several head rows in a row: the texts of rows that share an id, any may link.
    heads, pivot_id, after_head = [], None, False
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = sets_of(part.column("text"))
            out_a, out_b = [], []
            for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets, strict=True):
                if a is None:
                    heads = [*heads, s] if after_head and b == pivot_id else [s]
                    pivot_id, after_head = b, True
                    continue
                after_head = False
                for head in heads if b == pivot_id else []:
                    both = len(np.intersect1d(s, head, assume_unique=True))
                    if 4 * both >= 3 * (len(s) + len(head) - both):
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, sets_of: SetsOf) -> DataFrame:
    """The candidate ``pairs`` (a, b; distinct, pinned) that really link.

    b's text is sent once for every PER_PIVOT members or so, not once a pair."""
    mine = sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("ranges").alias("r_a"))
    theirs = sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("ranges").alias("r_b"))
    overlap = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, v: s + v)
    # A pivot has many members: its few numbers go to them, not they to it.
    theirs = pinned(theirs.join(pairs.select("b").distinct(), "b", "left_semi"), "pivot_sizes")
    bounded = pairs.join(mine, "a").join(small_side(theirs, BROADCAST_PIVOTS), "b")
    pairs = pinned(bounded.filter(7 * overlap >= 3 * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct(), "bounded")
    per_pivot = pinned(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_PIVOT).alias("salts")), "salts")
    pairs = pinned(pairs.join(small_side(per_pivot, BROADCAST_ROWS), "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")), "candidates")
    pivots = pairs.select("b", "salt").distinct()
    members = texts.join(small_side(pairs, BROADCAST_ROWS), texts["doc_id"] == F.col("a")).select("a", "b", "salt", "text")
    heads = texts.join(small_side(pivots, BROADCAST_ROWS), texts["doc_id"] == F.col("b")).select(
        F.lit(None).cast("long").alias("a"), "b", "salt", "text")
    return (members.unionByName(heads).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")
            .mapInArrow(lean(_verifier(sets_of)), "a long, b long").distinct())


def _n_and_pos() -> list[Column]:
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    return [F.shiftright(place, 32).cast("int").alias("n"), place.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")]


def _groups(rows: DataFrame) -> DataFrame:
    """Prefix rows (token, id, n, pos) whose shingle has other documents too. Hot shingles
    are kept as they are, and their rows are dealt over many tasks."""
    salt = F.when(F.col("place") < 0, F.pmod(F.xxhash64("id"), F.lit(HOT_SALTS))).otherwise(-1)
    rows = rows.withColumn("salt", salt)
    among = F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))
    return rows.withColumn("among", among).filter("place < 0 OR among > 1").select("token", "id", *_n_and_pos())


def _listed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_groups`` with ``nth``, the place in the list of the document's rows,
    and ``last``, the shingle before. Rows of one id and set size are one list, whatever
    their texts; ``pos`` never falls along it, so where a pair passes, it passes earlier too."""
    own = Window.partitionBy("id", "n").orderBy("pos", "token")
    return rows.withColumns({"nth": F.row_number().over(own), "last": F.lag("token").over(own)})


def _needed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_listed`` (pinned) without shingles whose documents all meet on one
    shingle just before."""
    again = rows.groupBy("token").agg(F.min("last").alias("low"), F.max("last").alias("high"),
                                      F.count("last").alias("after"), F.count(F.lit(1)).alias("all"))
    again = again.filter("low = high AND after = all").select("token")
    return rows.join(again, "token", "left_anti").drop("last")


def _once(rows: DataFrame) -> DataFrame:
    """Open ``rows`` with ``earlier``, the open shingles just before in their list."""
    before = Window.partitionBy("id", "n").orderBy("nth").rowsBetween(-EARLIER, -1)
    return rows.withColumn("earlier", F.collect_list("token").over(before))


def _link_rounds(rows: DataFrame, texts: DataFrame, sizes: DataFrame, sets_of: SetsOf) -> DataFrame:
    """All links needed for the components of the prefix rows."""
    n_rows = rows.count()
    links = tried = None
    open_rows = rows.withColumns({"c": F.col("id"), "served": F.lit(False)})
    before = None
    for round_no in itertools.count():
        # Pairs across components: all pairs of a shingle less those inside a component.
        parts = open_rows.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
        tokens = pinned(parts.groupBy("token").agg(
            F.sum("m").alias("members"), F.sum(F.col("m") * F.col("m")).alias("inside"),
            F.max(F.struct("m", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts"),
        ).filter("parts > 1"), f"tokens_{round_no}")
        left = tokens.agg(F.sum((F.col("members") * F.col("members") - F.col("inside")) / 2)).first()[0] or 0
        if left == 0:
            break
        few = OPEN_PAIRS_PER_ROW if round_no == 0 else LATER_PAIRS_PER_ROW
        last = left <= few * n_rows or (before is not None and 2 * left > before)
        before = left
        if last:
            # One side of every open pair is outside its shingle's main component.
            open_rows = pinned(_once(open_rows.join(tokens.select("token", "main"), "token")), "last")
            p = open_rows.filter("c <> main")
        else:
            # The pivot has the fewest rarer shingles before this one: of a group of
            # near copies, the one with the fewest words of its own.
            one = F.struct("served", "pos", F.hash("id"), "c", "id", "n")
            p = open_rows.groupBy("token").agg(F.min(one).alias("p"), F.min("c").alias("low"), F.max("c").alias("high"))
            p = p.filter("low < high").select("token", "p.*")
        p = p.select("token", *[F.col(c).alias(f"p_{c}") for c in p.columns if c in ("c", "id", "n", "pos", "earlier")])
        met = open_rows.join(p, "token")
        if last:
            # From one side only, and not where both have one more shingle just before.
            met = met.filter(((F.col("c") == F.col("main")) | (F.col("id") < F.col("p_id")))
                             & ~F.arrays_overlap("earlier", "p_earlier"))
        else:
            met = pinned(met, f"met_{round_no}")
        # The first shingle that two documents share passes here once, and the filter
        # holds for it, so a pair that links is never lost.
        pairs = met.filter((F.col("c") != F.col("p_c")) & _similar_size("", "p_")
                           & _enough(_rest("", "p_"), "", "p_"))
        pairs = pairs.select(F.greatest("id", "p_id").alias("a"), F.least("id", "p_id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pinned(pairs, f"pairs_{round_no}")
        found = pinned(_links(pairs, texts, sizes, sets_of), f"links_{round_no}")
        links = found if links is None else links.unionByName(found)
        if last:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
        open_rows = pinned(met.join(label, "id", "left").select(
            "token", "id", "n", "pos", "nth", F.coalesce("label", "id").alias("c"),
            (F.col("served") | (F.col("id") == F.col("p_id"))).alias("served")), f"open_{round_no}")
    return links


def _by_length(rows: DataFrame) -> DataFrame:
    """Prefix rows in partitions of set length. A partition ends at 4/3 of its
    start, so sets that link are in one partition or in neighbouring ones: each
    document takes part in its own and in the next."""
    part = F.floor(F.log(_n_and_pos()[0].cast("double")) / F.log(F.lit(4 / 3)) + LENGTH_SLACK)
    parts = rows.withColumn("part", F.explode(F.array(part, part + 1)))
    return parts.withColumn("token", F.xxhash64("token", "part")).drop("part")


def jaccard_classes(docs: DataFrame, sets_of: SetsOf = distinct_sets, by_length: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text_hash, n_shingles, component_id: one row per row.

    ``sets_of`` reads the sorted distinct 64-bit features of each text (word
    shingles by default); ``by_length`` lets documents meet in partitions of set length."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    profile = pinned(docs.mapInArrow(lean(_profiler(sets_of)), (
        "doc_id long, text_hash long, n long, sig_a long, sig_b long, ranges array<int>, bucket long, hits long")),
        "profile")
    rows = profile.filter("bucket IS NULL")
    named = rows.filter("doc_id IS NOT NULL AND n > 0")
    sets = named.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("copies"))
    member = named.join(sets, ["n", "sig_a", "sig_b"])
    copies = pinned(member.filter("copies > 1 AND doc_id <> class").select("doc_id", "text_hash").distinct(), "copies")
    same_id = member.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b")

    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, hits in profile.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits")).collect():
        counts[bucket] = hits
    buckets = spark.sparkContext.broadcast((counts, HOT * max(1.0, float(counts.mean()))))
    texts = docs.filter("doc_id IS NOT NULL").join(small_side(copies, BROADCAST_ROWS), ["doc_id", "text_hash"], "left_anti")
    prefix = texts.select("doc_id", "text").mapInArrow(
        lean(_prefixes(buckets, sets_of)), "token long, id long, place long")
    listed = pinned(_listed(_groups(_by_length(prefix) if by_length else prefix)), "prefixes")
    shared = pinned(_needed(listed), "needed")
    # Rows that share an id keep each its own sizes: any of their texts may link.
    sizes = named.select(F.col("doc_id").alias("id"), "n", "ranges").distinct()
    links = _link_rounds(shared, texts.select("doc_id", "text"), sizes, sets_of)
    links = same_id.select("a", "b") if links is None else links.unionByName(same_id.select("a", "b"))
    label = components(links).select(F.col("node").alias("class"), "component")
    ids = named.join(sets.select("n", "sig_a", "sig_b", "class"), ["n", "sig_a", "sig_b"]).join(label, "class", "left")
    ids = ids.select("doc_id", "text_hash", F.coalesce("component", "class").alias("component_id")).distinct()
    return join_null_safe(rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles")), ids,
                          ["doc_id", "text_hash"], "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id;
    all columns kept. Rows that share an id are one document, so one of them stays."""
    classes = pinned(jaccard_classes(docs), "classes")
    gone = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(small_side(pinned(gone, "near_copies"), BROADCAST_ROWS), "doc_id", "left_anti")
    repeats = classes.filter("component_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeats = pinned(repeats, "repeats")
    if repeats.isEmpty():
        return kept.select(*docs.columns)
    side = small_side(repeats, BROADCAST_ROWS)
    single = kept.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(side, "doc_id", "left_anti").unionByName(single).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents")).drop("text_hash")

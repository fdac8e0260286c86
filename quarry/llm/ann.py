"""Operator 8: approximate nearest neighbours by a hierarchical k-means tree.

Fit: a tree of k-means splits over at most SAMPLE_ROWS vectors (chosen by the
hash of their ids). Index: every vector descends to its leaf. Search: each query
walks the tree best bin first (a priority queue of nodes by the inner product
with their centroids) and visits the leaves it meets first.

How many is calibrated: for CALIBRATION vectors the true neighbours over all
rows are found by brute force, and the number of visits is widened until the
leaves visited hold TARGET of them. That is the recall to expect; tests measure
it against brute force.

Visits widen in steps (4 leaves, then 16, 64, ...; a step of more leaves than
there are tiles takes all that are left). After each step a query's k-th best
score so far is a bound: later leaves only return rows that reach it. A query that
still has fewer than it should goes on through the remaining leaves.

Work is dealt in tiles: neighbouring leaves together up to a bounded number of
rows, a larger leaf in several tiles. A query goes once to a tile that holds any
of its leaves, with one bit for each leaf of the tile, and queries come in blocks,
so a task holds neither a hot leaf whole nor a row for each visit. A tile returns
k rows of a query however many leaves it visits there. Copies are searched once:
of equal vectors only the k + 1 smallest ids can be among k nearest, and equal
queries share one search. Both are exact.

Scores are inner products in double precision of the stored vectors, summed per
pair in one order, so equal vectors tie exactly; ties go to the smaller id.

Defined cases: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, nor do rows with a null id;
rows that repeat an id and vector are one vector; a query with no other vector
has no rows; fewer than k candidates give all of them; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import lean, pinned, read_table, small_side

K = 20
QUERY_EVERY = 20
SAMPLE_ROWS = 50_000
LEAF_ROWS = 500
LEAF_SAMPLE = 20
BRANCHES = 8
CALIBRATION = 200
TARGET = 0.95
#: Leaves of the first step, and how many times more each next step reaches.
FIRST_VISITS, WIDEN = 4, 4
#: Rows of a tile and queries of a block at most, and their bytes as numbers of 8 bytes.
BLOCK, BLOCK_BYTES = 32_768, 16 << 20
#: Rows of a tile from which small tables are dealt over all cores.
LEAST_TILE = 2048
#: Bytes of the rows that a task deals out at once.
DEAL_BYTES = 4 << 20
#: Queries and rows of one matrix product, and candidates kept before they are cut to k.
QUERY_CHUNK, ROW_CHUNK, CANDIDATES = 1024, 2048, 1 << 17
#: Distinct copied vectors whose hashes are broadcast; beyond it a shuffle join.
BROADCAST_ROWS = 500_000
SEED = 7


class Tree:
    """Nested k-means: ``children[node]`` are node numbers, leaves have ``leaf >= 0``."""

    def __init__(self, sample: np.ndarray, leaf_size: int, branches: int = BRANCHES):
        self.centres, self.children, self.leaf = [sample.mean(0)], [[]], [-1]
        rng, self.leaves, todo = np.random.default_rng(SEED), 0, [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            part = self._split(sample[rows], branches, rng) if len(rows) > leaf_size else None
            if part is None:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for j in np.unique(part):
                mine = rows[part == j]
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), mine))
                self.centres.append(sample[mine].mean(0))
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(rows: np.ndarray, branches: int, rng: np.random.Generator) -> np.ndarray | None:
        """Cluster of each row, or None when the rows don't come apart."""
        distinct = np.unique(rows, axis=0)
        if len(distinct) < 2:
            return None
        centres = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
        for _ in range(12):
            part = Tree._nearest(rows, centres)
            centres = np.array([rows[part == j].mean(0) if (part == j).any() else centres[j]
                                for j in range(len(centres))])
        part = Tree._nearest(rows, centres)
        return part if len(np.unique(part)) > 1 else None

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres ** 2).sum(1) - 2 * rows @ centres.T).argmin(1)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest centre at each level."""
        out, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                kids = self.children[node]
                part = self._nearest(rows[at], self.centres[kids])
                todo += [(kid, at[part == j]) for j, kid in enumerate(kids)]
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        near, queue = self.centres @ query, [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, scores) of each query's k best rows; ties to smaller ids."""
    for at in range(0, len(queries), 512):
        block = queries[at:at + 512]
        rough = block @ rows.T
        for q, line in zip(block, rough, strict=True):
            found = np.arange(len(line))
            if len(line) > k:
                least = np.partition(line, -k)[-k]
                found = np.flatnonzero(line >= least - 1e-9 * (1 + abs(least)))
            exact = (rows[found] * q).sum(1)
            order = np.lexsort((ids[found], -exact))[:k]
            yield found[order], exact[order]


def _kind(rows: DataFrame) -> str:
    return rows.schema["embedding"].dataType.simpleString()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)))

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    length = sizes.agg(F.max_by("d", F.struct("n", -F.col("d")))).first()[0]
    return v.filter(F.size("embedding") == (length or 0))


def _without_far_copies(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors only the ``keep`` smallest ids. Only vectors whose hash
    has more rows than that are sorted, and each task drops its own surplus."""
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    many = pinned(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep).select("h"), "many")
    side = small_side(many, BROADCAST_ROWS)
    copied = rows.join(side, "h", "left_semi")
    best = Window.partitionBy("h", "embedding").orderBy("vec_id")
    copied = copied.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).drop("r")
    return rows.join(side, "h", "left_anti").unionByName(copied).select("vec_id", "embedding")


def _brute(rows: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best rows' vectors for a few queries, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            found = list(_top(shared.value, v, ids, k))
            q = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            p, s = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), batch.column("vec_id").take(pa.array(p)),
                                              pa.array(s), batch.column("embedding").take(pa.array(p))],
                                             ["q", "vec_id", "score", "embedding"])
    found = rows.mapInArrow(best, f"q long, vec_id long, score double, embedding {_kind(rows)}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # At most CALIBRATION * k rows.
    top = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).toArrow().combine_chunks()
    v, q = _matrix(top.column("embedding").combine_chunks()), top.column("q").to_numpy()
    return [v[q == i] for i in range(len(queries))]


def calibrated_visits(tree: Tree, queries: np.ndarray, truth: list[np.ndarray], target: float = TARGET) -> int:
    """Fewest leaf visits whose leaves hold ``target`` of the true neighbours."""
    needed = []
    for q, near in zip(queries, truth, strict=True):
        # Neither the query nor copies of it, and each neighbour once.
        near = np.unique(near[(near != q).any(1)], axis=0)
        if not len(near):
            continue
        place = {leaf: i + 1 for i, leaf in enumerate(tree.walk(q))}
        needed += [place[leaf] for leaf in tree.assign(near).tolist()]
    needed = np.sort(needed)
    return int(needed[min(len(needed), -(-int(target * 1000) * len(needed) // 1000)) - 1]) if len(needed) else 1


def _sample(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """About ``most`` vectors at most, chosen by the hash of their ids."""
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    chosen = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) <= int(share * (1 << 30)))
    table = chosen.select("vec_id", "embedding").toArrow().sort_by("vec_id")
    return _matrix(table.column("embedding").combine_chunks())


def _leaves(tree):
    """Each row with its leaf."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.assign(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])
    return find


class Tiles:
    """Where each leaf's rows lie. Small leaves share a tile, in the tree's order;
    a leaf of more than ``rows`` rows has ``parts`` tiles of its own. Each leaf has
    one slot in each of its tiles."""

    def __init__(self, counts: np.ndarray, rows: int):
        self.parts = -(-counts // rows)
        self.tile, self.slot, self.pos = (np.zeros(len(counts), np.int64) for _ in range(3))
        self.starts, held = [], rows                 # first slot of each tile; rows of the last one
        slots = 0
        for leaf in np.flatnonzero(counts).tolist():
            n = int(counts[leaf])
            if held + n > rows:
                self.starts.append(slots)
                held = 0
            self.tile[leaf], self.slot[leaf], self.pos[leaf] = len(self.starts) - 1, slots, slots - self.starts[-1]
            parts, held = int(self.parts[leaf]), held + n
            self.starts += range(slots + 1, slots + parts)
            slots += parts
            held = rows if parts > 1 else held
        self.n, self.starts = len(self.starts), [*self.starts, slots]

    def slots(self, leaves: np.ndarray) -> np.ndarray:
        parts = self.parts[leaves]
        ends = np.cumsum(parts)
        return np.repeat(self.slot[leaves] - ends + parts, parts) + np.arange(ends[-1] if len(ends) else 0)


def _dealt_rows(members: DataFrame, tiles: Tiles, blocks: int) -> DataFrame:
    """Each row with its tile and its leaf's place there, once for each block of queries."""
    table = members.sparkSession.createDataFrame(
        [(leaf, int(tiles.tile[leaf]), int(tiles.parts[leaf]), int(tiles.pos[leaf]))
         for leaf in np.flatnonzero(tiles.parts).tolist()], "leaf int, first int, parts int, pos int")
    out = members.join(F.broadcast(table), "leaf")
    tile = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return out.select("vec_id", "embedding", "pos", tile.alias("tile"),
                      F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("query_block"))


def _deal_queries(tree, tiles, at: int, to: int):
    """Each query once for each tile with leaves among its visits ``at`` to ``to``,
    with a bit for each of the tile's leaves."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = tiles.value
        for batch in batches:
            width = 8 * len(batch.column("embedding").values) // max(1, batch.num_rows)
            step = max(1, DEAL_BYTES // (where.n * width + where.starts[-1] + 1))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                met = np.zeros((part.num_rows, where.starts[-1]), bool)
                for i, q in enumerate(_matrix(part.column("embedding"))):
                    met[i, where.slots(np.fromiter(islice(tree.value.walk(q), at, to), np.int64))] = True
                rows, number, bits = [], [], []
                for tile, (low, high) in enumerate(zip(where.starts, where.starts[1:], strict=False)):
                    who = np.flatnonzero(met[:, low:high].any(1))
                    rows.append(who)
                    number.append(np.full(len(who), tile, np.int32))
                    bits += [line.tobytes() for line in np.packbits(met[who, low:high], axis=1)]
                row = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(row) for c in part.columns), pa.array(bits, pa.binary()),
                     pa.array(np.concatenate([np.zeros(0, np.int32), *number]))], [*part.schema.names, "leaves", "tile"])
    return lean(deal)


def _cut(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, by query and rank; ties to smaller ids."""
    order = np.lexsort((ids, -scores, who))
    who = who[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    order = order[rank < k]
    return who[rank < k], ids[order], scores[order]


def tile_best(queries: np.ndarray, met: np.ndarray, bounds: np.ndarray, rows: np.ndarray, ids: np.ndarray,
              starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): each query's k best rows of the leaves it meets (``met``, a
    row per query) that reach its bound. Leaf p is ``rows[starts[p]:starts[p + 1]]``."""
    least = bounds.copy()
    norms = np.sqrt((queries ** 2).sum(1))
    best = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
    new, held = [], 0

    def cut() -> None:
        nonlocal best, new, held
        best = _cut(*(np.concatenate(x) for x in zip(best, *new, strict=True)), k)
        new, held = [], 0
        last = np.flatnonzero(np.diff(best[0], append=-1))                  # a query's worst row
        full = last[np.diff(last, prepend=-1) == k]
        least[best[0][full]] = np.maximum(least[best[0][full]], best[2][full])

    for p, low in ((p, low) for p in range(met.shape[1]) for low in range(starts[p], starts[p + 1], ROW_CHUNK)):
        leaf = rows[low:min(low + ROW_CHUNK, starts[p + 1])].astype(np.float64)
        longest = np.sqrt((leaf ** 2).sum(1).max())
        visitors = np.flatnonzero(met[:, p])
        for at in range(0, len(visitors), QUERY_CHUNK):
            who = visitors[at:at + QUERY_CHUNK]
            q = queries[who]
            rough = q @ leaf.T
            # More than the two ways to sum a product differ by.
            slack = 1e-12 * norms[who] * longest
            line = least[who] - 1e-9 * (1 + np.abs(np.nan_to_num(least[who], neginf=0))) - slack
            hit = rough >= line[:, None]
            many = np.flatnonzero(hit.sum(1) > 2 * k)
            if len(many):
                kth = np.partition(rough[many], -k, axis=1)[:, -k]
                line = np.maximum(line[many], kth - 1e-9 * (1 + np.abs(kth)) - slack[many])
                hit[many] = rough[many] >= line[:, None]
            i, j = np.nonzero(hit)
            piece = max(1, DEAL_BYTES // (8 * leaf.shape[1]))
            for some in range(0, len(i), piece):
                a, b = i[some:some + piece], j[some:some + piece]
                exact = (leaf[b] * q[a]).sum(1)
                fits = exact >= least[who[a]]
                new.append((who[a][fits], ids[low + b[fits]], exact[fits]))
                held += int(fits.sum())
                if held > CANDIDATES:
                    cut()
    cut()
    return best


def _score(k: int):
    def score(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, who = _matrix(queries.column("embedding").combine_chunks()), queries.column("query_id").to_numpy()
        bits = b"".join(queries.column("leaves").to_pylist())
        met = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(len(who), -1), axis=1)
        bounds = queries.column("bound").to_numpy()
        rows = rows.sort_by("pos")
        v, pos = rows.column("embedding").combine_chunks(), rows.column("pos").to_numpy()
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(pos), -1)
        met = met[:, :pos[-1] + 1].astype(bool)
        starts = np.searchsorted(pos, np.arange(met.shape[1] + 1))
        found, ids, scores = tile_best(q, met, np.where(np.isnan(bounds), -np.inf, bounds), flat,
                                       rows.column("vec_id").to_numpy(), starts, k)
        return pa.table({"query_id": who[found], "vec_id": ids, "score": scores})
    return score


def _visit(members: DataFrame, asked: DataFrame, found: DataFrame | None, k: int, tree, tiles, at: int, to: int,
           rows: int, n: int) -> DataFrame:
    """The k best of ``found`` and of the leaves at ``at`` to ``to`` of the walk of
    each of the ``n`` queries (query_id, embedding)."""
    spark = members.sparkSession
    if found is None:
        asked = asked.withColumn("bound", F.lit(None).cast("double"))
    else:
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"))
        asked = asked.join(kth.filter(F.col("n") == k).select("query_id", "bound"), "query_id", "left")
    blocks = max(1, -(-n // rows))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("query_block")
    # Walking the tree costs far more than its few bytes show: deal the queries over all cores.
    asked = asked.select("query_id", "embedding", "bound", block).repartition(
        spark.sparkContext.defaultParallelism, "query_id")
    left = asked.mapInArrow(
        _deal_queries(tree, tiles, at, to),
        f"query_id long, embedding {_kind(asked)}, bound double, query_block int, leaves binary, tile int")
    right = _dealt_rows(members, tiles.value, blocks)
    tile = ["tile", "query_block"]
    new = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _score(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    new = new if found is None else new.unionByName(found)
    return pinned(new.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"), "found")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, target: float = TARGET,
            leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``vectors``, ``queries`` (vec_id, embedding; queries are among the vectors)
    -> query_id, rank, vec_id, score: each query's k nearest others."""
    spark = vectors.sparkSession
    rows = pinned(usable(vectors).distinct(), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = rows.count()
    if n == 0:
        return empty
    sample = _sample(rows, SAMPLE_ROWS, 0)
    leaf_size = max(LEAF_SAMPLE, leaf_rows * len(sample) // n)
    fitted = Tree(sample, leaf_size)
    probe = _sample(rows, CALIBRATION, 1)
    tree = spark.sparkContext.broadcast(fitted)
    members = pinned(_without_far_copies(rows, k + 1).mapInArrow(
        _leaves(tree), f"vec_id long, embedding {_kind(rows)}, leaf int"), "members")
    kept = members.select("vec_id", "embedding")
    most = calibrated_visits(fitted, probe, _brute(kept, probe, k + 1) if len(probe) else [], target)
    counts = np.zeros(fitted.leaves, np.int64)
    for r in members.groupBy("leaf").count().collect():      # one row per leaf
        counts[r["leaf"]] = r["count"]
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * sample.shape[1])))
    spread = -(-int(counts.sum()) // (2 * spark.sparkContext.defaultParallelism))
    tiles = spark.sparkContext.broadcast(Tiles(counts, min(block, max(LEAST_TILE, spread))))

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = pinned(rows.join(asked, "vec_id", "left_semi"), "asked")
    groups = pinned(asked.groupBy("embedding").agg(F.min("vec_id").alias("query_id")).select("query_id", "embedding"), "groups")
    n_groups = groups.count()
    found, at, to = None, 0, FIRST_VISITS
    while at < most:
        to = min(to, most) if to < tiles.value.n else most
        found = _visit(members, groups, found, k + 1, tree, tiles, at, to, block, n_groups)
        at, to = to, to * WIDEN
    # A query with too few rows goes on until it has them or has seen all leaves.
    at, to = most, most * WIDEN
    while at < fitted.leaves:
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = pinned(groups.join(counts, "query_id", "left")
                       .filter(F.coalesce("n", F.lit(0)) <= k).select("query_id", "embedding"), "short")
        if not (n_short := short.count()):
            break
        found = _visit(members, short, found, k + 1, tree, tiles, at, min(to, fitted.leaves), block, n_short)
        at, to = to, to * WIDEN
    # Every query of a group of equal vectors takes its list, without itself.
    shares = asked.join(groups, "embedding").select(F.col("vec_id").alias("own"), "query_id")
    out = shares.join(found, "query_id").filter("own <> vec_id")
    rank = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        F.col("own").alias("query_id"), "rank", "vec_id", "score")


def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.pmod(F.col("vec_id"), F.lit(QUERY_EVERY)) == 0))

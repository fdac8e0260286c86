"""Exact cosine top-k.

Brute-force exact search has to compare every query with every document;
the job never turns those comparisons into rows. Each task multiplies a matrix
of queries with matrices of documents (numpy), keeps a running best k per query
and emits it once at the end. A final per-query window (partial
WindowGroupLimit before the shuffle) merges the tasks' candidates.

* Few queries (bytes checked against ``max_broadcast_bytes``, rows of an answer
  against ``BROADCAST_CANDIDATES``) are broadcast and document vectors are read where
  they lie, never shuffled; each partition answers each query with k rows.
* Any number of queries: documents are dealt into tiles and queries into blocks
  of bounded bytes by the hash of their ids; every block meets every tile in one
  task of a cogrouped shuffle. Nothing of either side passes through the driver.
  A tile lays its documents out in leaves of near ones, each with the box around it.
  No document of a leaf scores more than ``(|q|^2 + |d|^2 - gap^2) / 2``, with the gap
  from the query to the box, so a query meets only leaves that can reach its k-th best
  so far. Where vectors have no near ones it meets all, and the result is exact anyway.

Vectors come as unit vectors: from the store, which keeps them, or computed once
per row before they are dealt (``with_units``); no norm is taken in the kernel.

Ids are of any type (numbers, titles). A query meets the documents whose vector
has its own length. Zero and missing vectors, and those with missing or
non-finite components, have no cosine (NULL, never NaN) and are skipped (S2).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.plans.topk import OUTPUT_PLACES, SCORE_PLACES, max_k, ranked, requested_k
from quarry.session import shared_dir

# Bytes of query vectors that are broadcast (they pass through the driver).
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024
# Bytes of a tile of documents and of a block of queries.
TILE_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 32 * 1024 * 1024
# Rows that a partition may answer to broadcast queries (queries x k).
BROADCAST_CANDIDATES = 500_000
# Queries of a block at most, and at least when blocks are cut to use all cores.
BLOCK_QUERIES, LEAST_BLOCK = 262_144, 1024
# Documents of a leaf, leaves that a query meets first, and leaves whose bounds are taken at once.
LEAF_DOCS, FIRST_LEAVES, LEAF_STEP = 256, 4, 32
# Queries that walk a tile's leaves together, and candidates kept before they are cut to k.
WALK_QUERIES, CANDIDATES = 4096, 1 << 17
# Components (those that vary most) that boxes are made of.
BOX_DIMS = 16
# Queries and documents of one matrix product (bounds the score matrix).
QUERY_CHUNK = 512
DOC_CHUNK = 16_384
# Scores nearer than this may be equal when rounded.
SLACK = 2 * 10.0 ** -SCORE_PLACES


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def direction(vec: Column) -> Column:
    """(norm, unit) of a vector; ``unit`` is NULL when it has no direction. The
    vector and its norm are bound once: either may be a costly expression."""
    def of(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        return _let(F.sqrt(squares), lambda n: F.struct(n.alias("norm"), F.when(
            (n > 0) & (n < F.lit(float("inf"))),                    # NaN is above infinity
            F.transform(v, lambda x: x.cast("double") / n)).alias("unit")))
    return _let(vec, of)


def with_units(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``df`` with ``norm`` and ``unit``."""
    rest = [c for c in df.columns if c not in ("norm", "unit")]
    # One value per row leaves the generator, so nothing above it runs the encoder again.
    return (df.select(*rest, F.explode_outer(F.array(direction(F.col(vec)))).alias("__direction"))
            .select(*rest, "__direction.norm", "__direction.unit"))


def units(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, unit); stored unit vectors are taken as they are. Rows without a
    direction keep a NULL, which the kernel skips."""
    if "unit" in df.columns:
        return df.select(*keep, "unit")
    return df.select(*keep, direction(F.col("embedding"))["unit"].alias("unit"))


def _by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids ascending, unit vectors)}."""
    rows: dict[int, list] = {}
    for i, v in zip(ids, vectors, strict=True):
        if i is not None and v is not None and len(v):
            rows.setdefault(len(v), []).append((i, v))
    out = {}
    for length, some in rows.items():
        keys = as_ids([i for i, _ in some])
        by_id = np.argsort(keys, kind="stable")
        out[length] = keys[by_id], np.array([v for _, v in some], dtype=np.float64)[by_id]
    return out


def as_ids(values: list) -> np.ndarray:
    """Ids of any type as an array of objects."""
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


class Best:
    """Running best k (score, id) of each query; ties by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = [np.empty(0, dtype=object)] * n
        self.scores = [np.empty(0)] * n
        self.least = np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: one row per query, one column per document, ids ascending."""
        if not scores.shape[1]:
            return
        # A document whose score cannot reach a query's k-th best is passed over; the
        # slack is more than rounding moves a score.
        line = self.least - SLACK
        for i in np.flatnonzero(scores.max(axis=1) >= line):
            found = np.flatnonzero(scores[i] >= line[i])
            rounded = np.round(scores[i][found], SCORE_PLACES)
            if len(found) > self.k:
                least = np.partition(rounded, -self.k)[-self.k]
                above, ties = np.flatnonzero(rounded > least), np.flatnonzero(rounded == least)
                found = found[np.concatenate([above, ties[:self.k - len(above)]])]   # ties: the lowest ids
            s = np.concatenate([self.scores[i], scores[i][found]])
            d = np.concatenate([self.ids[i], ids[found]])
            order = sorted(range(len(s)), key=lambda j: (-round(s[j], SCORE_PLACES), d[j]))[:self.k]
            self.scores[i], self.ids[i] = s[order], d[order]
            if len(order) == self.k:
                self.least[i] = s[order[-1]]

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        n = [len(s) for s in self.scores]
        return pd.DataFrame({"query_id": np.repeat(query_ids, n), "doc_id": np.concatenate(self.ids),
                             "score": np.concatenate(self.scores)})


class _Scorer:
    """Running best k of a block of queries over any number of documents."""

    def __init__(self, queries: dict, k: int, query_chunk: int):
        self.chunks = []
        for length, (qids, q) in queries.items():
            for at in range(0, len(qids), query_chunk):
                part = qids[at:at + query_chunk]
                self.chunks.append((length, part, q[at:at + query_chunk], Best(len(part), k)))

    def add(self, ids: list, vectors: list) -> None:
        docs = _by_length(ids, vectors)
        for length, _, q, best in self.chunks:
            if length in docs:
                keys, m = docs[length]
                for at in range(0, len(keys), DOC_CHUNK):
                    best.add(q @ m[at:at + DOC_CHUNK].T, keys[at:at + DOC_CHUNK])

    def rows(self) -> pd.DataFrame:
        found = [best.rows(qids) for _, qids, _, best in self.chunks]
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})


def _partition_topk(k: int, block, query_chunk: int = QUERY_CHUNK):
    """mapInPandas body: best k documents per query of one partition."""
    def run(batches):
        scorer = _Scorer(block.value, k, query_chunk)
        for pdf in batches:
            scorer.add(pdf["doc_id"].tolist(), pdf["unit"].tolist())
        yield scorer.rows()

    return run


def _near_order(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in leaves of at most ``size``, split at the median of the
    component that varies most."""
    order, starts, todo = np.arange(len(rows)), [], [(0, len(rows))]
    while todo:
        low, high = todo.pop()
        if high - low <= size:
            starts.append(low)
            continue
        part, half = rows[order[low:high]], (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(part[:, part.var(axis=0).argmax()], half)]
        todo += [(low, low + half), (low + half, high)]
    return order, np.array([*sorted(starts), len(rows)])


def _first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Positions, ascending, of the first k of each group of equal rows."""
    same = np.unique(np.ascontiguousarray(rows).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    same = same[order]
    return np.sort(order[np.arange(len(same)) - np.searchsorted(same, same) < k])


class Leaves:
    """A tile's unit vectors, rows in the order of their ids, in leaves with boxes."""

    def __init__(self, rows: np.ndarray, k: int, leaf_docs: int | None = None):
        self.k, kept = k, _first_copies(rows, k)       # of equal vectors only k can be among the best
        rows = rows if len(kept) == len(rows) else rows[kept]
        order, self.starts = _near_order(rows, leaf_docs or LEAF_DOCS)
        self.rows, self.place = rows[order], kept[order]
        self.dims = np.argsort(-rows.var(axis=0), kind="stable")[:BOX_DIMS]
        firsts = self.starts[:-1]
        self.low = np.minimum.reduceat(self.rows[:, self.dims], firsts, axis=0)
        self.high = np.maximum.reduceat(self.rows[:, self.dims], firsts, axis=0)
        self.square = np.maximum.reduceat(np.einsum("ij,ij->i", self.rows, self.rows), firsts)
        self.centre = np.add.reduceat(self.rows, firsts, axis=0) / np.diff(self.starts)[:, None]

    def best(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of each query's k best rows; ties to the first place."""
        walk, n = _Walk(self, queries), len(self.centre)
        near = np.concatenate([self.nearest(queries[at:at + QUERY_CHUNK]) for at in range(0, len(queries), QUERY_CHUNK)])
        who, leaf = np.repeat(np.arange(len(queries)), near.shape[1]), near.ravel()
        order = np.argsort(leaf, kind="stable")
        who, ends = who[order], np.searchsorted(leaf[order], np.arange(n + 1))
        for i in np.flatnonzero(np.diff(ends)):
            walk.meet(i, who[ends[i]:ends[i + 1]])
        walk.cut()
        for at in range(0, n, LEAF_STEP):
            reach = np.ascontiguousarray((self.bounds(queries, at) >= (walk.least - SLACK)[:, None]).T)
            for i, line in enumerate(reach, at):
                line[who[ends[i]:ends[i + 1]]] = False           # met above
                if (more := np.flatnonzero(line)).size:
                    walk.meet(i, more)
        walk.cut()
        return walk.found

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """The leaves with the nearest centres, a row for each query."""
        first = min(FIRST_LEAVES, len(self.centre))
        near = 2 * queries @ self.centre.T - (self.centre ** 2).sum(axis=1)
        return np.argpartition(near, -first, axis=1)[:, -first:]

    def bounds(self, queries: np.ndarray, at: int) -> np.ndarray:
        """Upper bounds of the scores of each query in the next leaves."""
        gaps, some = 0.0, slice(at, at + LEAF_STEP)
        for j, dim in enumerate(self.dims):
            q = queries[:, dim, None]
            gap = np.maximum(self.low[some, j] - q, q - self.high[some, j])
            gaps = gaps + np.maximum(gap, 0, out=gap) ** 2
        return ((queries ** 2).sum(axis=1)[:, None] + self.square[some] - gaps) / 2


class _Walk:
    """Running best k of some queries over a tile's leaves."""

    def __init__(self, leaves: Leaves, queries: np.ndarray):
        self.leaves, self.queries = leaves, queries
        self.least = np.full(len(queries), -np.inf)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.held = [], 0

    def meet(self, leaf: int, who: np.ndarray) -> None:
        low, high = self.leaves.starts[leaf:leaf + 2]
        k, line = self.leaves.k, self.least[who] - SLACK
        scores = self.queries[who] @ self.leaves.rows[low:high].T
        hit = scores >= line[:, None]
        many = np.flatnonzero(hit.sum(axis=1) > 2 * k)
        if len(many):
            kth = np.partition(scores[many], -k, axis=1)[:, -k] - SLACK
            hit[many] = scores[many] >= np.maximum(line[many], kth)[:, None]
        i, j = np.divmod(np.flatnonzero(hit), high - low)
        self.new.append((who[i], self.leaves.place[low + j], scores[i, j]))
        self.held += len(i)
        if self.held > CANDIDATES:
            self.cut()

    def cut(self) -> None:
        who, place, score = (np.concatenate(x) for x in zip(self.found, *self.new, strict=True))
        self.new, self.held = [], 0
        order = np.lexsort((place, -np.round(score, SCORE_PLACES), who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order = order[rank < self.leaves.k]
        self.found = who, place, score = who[order], place[order], score[order]
        last = np.flatnonzero(np.diff(who, append=-1))            # each query's worst row
        full = last[np.diff(last, prepend=-1) == self.leaves.k]
        self.least[who[full]] = score[full]


def _unit_rows(table: pa.Table, key: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """{length: (ids ascending, unit vectors)}; rows without id or direction are left out."""
    if table.column(key).null_count:
        table = table.filter(pc.is_valid(table.column(key)))
    lengths = pc.fill_null(pc.list_value_length(table.column("unit")), 0).to_numpy()
    out = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        some = table if (lengths == length).all() else table.filter(pa.array(lengths == length))
        some = some.take(pc.sort_indices(some.column(key)))
        rows = some.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        fits = np.isfinite(rows).all(axis=1)
        if fits.any():
            rows = rows if fits.all() else rows[fits]
            out[length] = some.column(key).combine_chunks().filter(pa.array(fits)), rows.astype(np.float64, copy=False)
    return out


def _tile_topk(k: int, schema: pa.Schema, query_chunk: int = WALK_QUERIES):
    """Cogroup body: best k documents of one tile for each query of one block."""
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        tile, out = _unit_rows(docs, "doc_id"), [schema.empty_table()]
        for length, (qids, q) in _unit_rows(queries, "query_id").items():
            if length not in tile:
                continue
            ids, rows = tile.pop(length)
            leaves = Leaves(rows, k)
            del rows
            for at in range(0, len(q), query_chunk):
                who, place, score = leaves.best(q[at:at + query_chunk])
                out.append(pa.table([qids.take(pa.array(at + who)), ids.take(pa.array(place)), pa.array(score)],
                                    names=schema.names).cast(schema))
        return pa.concat_tables(out)

    return run


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The vectors of a list column without a Python number for each component."""
    out = []
    for chunk in column.chunks:
        flat, bounds = chunk.flatten().to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += np.split(flat, (bounds - bounds[0])[1:-1]) if len(chunk) else []
    return out


def candidate_schema(doc_vectors: DataFrame, query_vectors: DataFrame) -> StructType:
    return StructType([StructField("query_id", query_vectors.schema["query_id"].dataType),
                       StructField("doc_id", doc_vectors.schema["doc_id"].dataType),
                       StructField("score", DoubleType())])


def _vector_sizes(vectors: DataFrame) -> tuple[int, int]:
    """(bytes, rows) of unit vectors."""
    size = F.sum(F.coalesce(F.size("unit"), F.lit(0)).cast("long") * 8)
    return tuple(vectors.agg(F.coalesce(size, F.lit(0)), F.count(F.lit(1))).first())


def tiled_candidates(docs: DataFrame, queries: DataFrame, k: int, tile_bytes: int = TILE_BYTES,
                     block_bytes: int = BLOCK_BYTES, query_chunk: int = WALK_QUERIES) -> DataFrame:
    """Best k (query_id, doc_id, score) of every query in every tile of documents.

    docs: (doc_id, unit); queries: (query_id, unit)."""
    schema = candidate_schema(docs, queries)
    tiles = max(1, math.ceil(_vector_sizes(docs)[0] / tile_bytes))
    size, n = _vector_sizes(queries)
    # A task for each core, unless it would have few queries; a block is a copy of the documents.
    spread = min(math.ceil(n / LEAST_BLOCK), math.ceil(docs.sparkSession.sparkContext.defaultParallelism / tiles))
    blocks = max(1, math.ceil(size / block_bytes), math.ceil(n / BLOCK_QUERIES), spread)

    def dealt(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    tile_docs = docs.withColumn("tile", dealt("doc_id", tiles)).withColumn("block", copies(blocks))
    block_queries = queries.withColumn("block", dealt("query_id", blocks)).withColumn("tile", copies(tiles))
    return (tile_docs.groupBy("tile", "block").cogroup(block_queries.groupBy("tile", "block"))
            .applyInArrow(_tile_topk(k, to_arrow_schema(schema), query_chunk), schema))


def cosine_candidates(doc_vectors: DataFrame, query_vectors: DataFrame, k: int,
                      max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                      query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """Per-task best k (query_id, doc_id, score) for every query."""
    spark = doc_vectors.sparkSession
    docs, queries = units(doc_vectors, "doc_id"), units(query_vectors, "query_id")
    size, n = _vector_sizes(queries)
    if size > max_broadcast_bytes or n * k > BROADCAST_CANDIDATES:
        # Sized and dealt out: vectors that come from a model are computed once.
        path = shared_dir(spark, "dense_units")
        docs.write.parquet(path)
        return tiled_candidates(spark.read.schema(docs.schema).parquet(path), queries, k)
    # One block, its bytes proven above.
    rows = queries.toArrow()
    if not rows.num_rows:
        return spark.createDataFrame([], candidate_schema(doc_vectors, query_vectors))
    block = spark.sparkContext.broadcast(
        _by_length(rows.column("query_id").to_pylist(), _arrays(rows.column("unit"))))
    return docs.mapInPandas(_partition_topk(k, block, query_chunk), candidate_schema(doc_vectors, query_vectors))


def dense_search(doc_vectors: DataFrame, query_vectors: DataFrame,
                 max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                 query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, doc_id, score) top ``top_k`` by cosine.

    doc_vectors: (doc_id, embedding[, unit]); query_vectors: (query_id, embedding, top_k).
    A query set that grows with the corpus belongs to ``max_broadcast_bytes=0``."""
    # Query vectors are read several times (k, sizes, scoring) and may
    # come from a model: pin them once in the shared checkpoint folder.
    shared_dir(query_vectors.sparkSession)
    query_vectors = with_units(query_vectors.select(
        "query_id", "embedding", requested_k().alias("top_k"))).drop("embedding", "norm").checkpoint()
    k_max = max_k(query_vectors)
    schema = candidate_schema(doc_vectors, query_vectors)
    cands = (cosine_candidates(doc_vectors, query_vectors, k_max, max_broadcast_bytes, query_chunk)
             if k_max > 0 else doc_vectors.sparkSession.createDataFrame([], schema))
    out = ranked(cands, query_vectors.select("query_id", "top_k"), k_max)
    return out.select("query_id", "rank", "doc_id", F.round("score", OUTPUT_PLACES).alias("score"))

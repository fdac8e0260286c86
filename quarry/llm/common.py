"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

#: Text bytes handled at once by an Arrow task, whatever the batch it was given.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch that carries whole texts: the executor and its Python worker
#: each hold two of them. Spark's default is 10,000 rows.
TEXT_BATCH_ROWS = 2_000
# Parameter numbers of the C library's mallopt.
M_MMAP_THRESHOLD, M_ARENA_MAX = -3, -8


def lean(task: Callable, tokens: bool = False) -> Callable:
    """``task`` (a mapInArrow body) that leaves no memory behind in a reused
    worker: Arrow allocates from the system, a tokenizer that this or an earlier
    task loaded goes (with ``tokens`` it stays for the next task), and freed memory
    is given back when the task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        _few_arenas()
        kept = sys.modules.get("quarry.llm.tokens")
        if kept is not None and not tokens:
            kept.unload()
        try:
            yield from task(batches)
        finally:
            if not tokens and (kept := sys.modules.get("quarry.llm.tokens")) is not None:
                kept.unload()
            _give_back()
    return run


def _few_arenas() -> None:
    """Large blocks go back when freed, and threads share one heap."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(M_MMAP_THRESHOLD, 1 << 20)
        mallopt(M_ARENA_MAX, 1)
    except (AttributeError, OSError):       # no such call in this C library
        pass


def _give_back() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # no such call in this C library
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole, as the scan splits it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in the jobs that run inside; a smaller
    setting of the session stays, and its setting is put back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    if 0 < int(given) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, given)


def pinned(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back: cuts
    the lineage, so a lost executor costs a reread and not a recomputation.
    ``batch_rows`` bounds the Arrow batches of its Python tasks."""
    path = shared_dir(df.sparkSession, f"llm_{name}")
    with arrow_batches(df.sparkSession, batch_rows) if batch_rows else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows. A plain count (partial sums
    per task), so no task gathers rows to answer it."""
    return df.count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when ``df`` (pinned, fixed-width columns) is proven to
    have at most ``rows`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``max_bytes`` of text (one
    row at least), so a batch of very long texts needs bounded memory."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the number in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it a name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which NULL keys meet; keeps the left keys."""
    names = {c: unused(left, f"__{c}") for c in on}
    other = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for c, name in names.items():
        cond &= F.col(c).eqNullSafe(F.col(name))
    return left.join(other, cond, how).drop(*names.values())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row or element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of a non-null bigint array, inside the row.

    Blocks are summed first and each block is then summed on its own, so that
    the cost stays near linear in the array's length."""
    def sums(arr: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(arr, none, lambda acc, v: F.struct(
            (acc["s"] + v).alias("s"), F.array_append(acc["a"], acc["s"] + v).alias("a")), lambda acc: acc["a"])

    last = F.floor((F.size(values) - 1) / block).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), last), lambda b: sums(F.slice(values, b * block + 1, block)))
    ).otherwise(F.array().cast("array<array<bigint>>"))
    return let(blocks, lambda bs: F.flatten(F.zip_with(
        bs, F.concat(F.array(F.lit(0).cast("bigint")), sums(F.transform(bs, lambda b: F.element_at(b, -1)))),
        lambda b, before: F.transform(F.coalesce(b, F.array().cast("array<bigint>")), lambda v: v + before))))

"""Embedding store (O06, O71): append-only versions, merged when read.

    <store>/method=<name>/version=<n>/   vectors of one write, never changed
    <store>/method=<name>/manifest=<n>/  the versions that are live since then

A write adds a version with the rows that changed, then commits a manifest that
names it; of several versions the newest row of a document wins at read. A
rebuild's manifest names its own version only. Readers take the newest committed
manifest, so during any write they see one whole state, and an unfinished write
is never seen. ``compact`` folds the versions of a method into one.

Rows are (doc_id, content_hash, embedding, norm, unit): the unit vector is taken
once, when the vector is written. ``doc_id`` keeps the type of the corpus id (a
number, or a title).
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.dense import with_units
from quarry.plans.joins import is_bounded
from quarry.session import shared_dir

EMBEDDING_COLUMNS = ["method", "doc_id", "content_hash", "embedding"]
UNIT_COLUMNS = ["norm", "unit"]
STORED = [*EMBEDDING_COLUMNS[1:], *UNIT_COLUMNS]
# Documents with several live versions whose newest one is broadcast.
SUPERSEDED_ROWS = 2_000_000


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match. Errors of the file system are raised, not read as "none"."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in status] if status is not None else []


def _folder(path: str, method: str) -> str:
    return f"{path.rstrip('/')}/method={quote(method, safe='')}"


def _numbers(spark: SparkSession, folder: str, kind: str, mark: str = "") -> list[int]:
    names = (re.search(rf"/{kind}=(\d+)(?:/|$)", p) for p in found(spark, f"{folder}/{kind}=*{mark}"))
    return sorted(int(m[1]) for m in names if m)


def live_versions(spark: SparkSession, path: str, method: str) -> list[int]:
    """The versions that a reader of ``method`` has to merge (none: not stored)."""
    folder = _folder(path, method)
    foreign = [p for p in found(spark, f"{folder}/*") if not re.search(r"/(version|manifest)=\d+$", p)]
    if foreign:
        raise ValueError(f"not a version of an embedding store: {foreign[0]}")
    manifests = _numbers(spark, folder, "manifest", "/_SUCCESS")
    if not manifests:
        return []
    rows = spark.read.schema("version long").parquet(f"{folder}/manifest={manifests[-1]}").collect()
    return sorted(r["version"] for r in rows)


def methods(spark: SparkSession, path: str) -> list[str]:
    """The methods with a committed state."""
    marks = found(spark, f"{path.rstrip('/')}/method=*/manifest=*/_SUCCESS")
    return sorted({unquote(re.search(r"/method=([^/]*)/", p)[1]) for p in marks})


def list_methods(spark: SparkSession, path: str) -> DataFrame:
    """The methods that the store holds: (method)."""
    return spark.createDataFrame([(m,) for m in methods(spark, path)], "method string")


def store_exists(spark: SparkSession, path: str) -> bool:
    """True when the store holds a method."""
    return bool(methods(spark, path))


def write_version(rows: DataFrame, path: str, method: str, replace: bool = False) -> int:
    """Add ``rows`` (doc_id, content_hash, embedding) as a version and commit it;
    with ``replace`` it is the method's only live one. Two writers that take the
    same number collide on the folder, and the later one fails."""
    spark, folder = rows.sparkSession, _folder(path, method)
    live = live_versions(spark, path, method)
    number = 1 + max([0, *_numbers(spark, folder, "version"), *_numbers(spark, folder, "manifest")])
    with_units(rows).select(*STORED).write.parquet(f"{folder}/version={number}")
    named = [(number,)] if replace else [(n,) for n in [*live, number]]
    spark.createDataFrame(named, "version long").coalesce(1).write.parquet(f"{folder}/manifest={number}")
    return number


def read_versions(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(doc_id, content_hash, embedding, norm, unit, version): the newest row of
    each document. With one live version it is a plain scan; else the few
    documents that have several are looked up by id (narrow columns only)."""
    live = live_versions(spark, path, method)
    if not live:
        raise ValueError(f"the store has no method {method!r}")
    folder = _folder(path, method)
    parts = [spark.read.parquet(f"{folder}/version={n}").select(*STORED, F.lit(n).cast("long").alias("version"))
             for n in live]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    if len(parts) == 1:
        return rows
    shared_dir(spark)
    newest = (rows.groupBy("doc_id").agg(F.max("version").alias("newest"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("doc_id", "newest").checkpoint())
    side = F.broadcast(newest) if is_bounded(newest, SUPERSEDED_ROWS) else newest
    return (rows.join(side, "doc_id", "left").filter("newest IS NULL OR version = newest").drop("newest"))


def load_embeddings(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """(method, doc_id, content_hash, embedding, norm, unit) of one method
    (only its folders are read), or of all."""
    names = methods(spark, path) if method is None else [method]
    if not names:
        raise ValueError(f"no embedding store at {path!r}")
    out = None
    for m in names:
        part = read_versions(spark, path, m).select(F.lit(m).alias("method"), *STORED)
        out = part if out is None else out.unionByName(part)
    return out


def save_embeddings(df: DataFrame, path: str, mode: str = "append", check_unique: bool = True) -> None:
    """Write ``df`` (method, doc_id, content_hash, embedding), one version per
    method; (method, doc_id) must be unique in it (S21).

    ``append`` adds to a method (a document's newer row wins), ``overwrite``
    replaces it; the methods that ``df`` does not name stay as they are."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be 'append' or 'overwrite', not {mode!r}")
    rows = df.select(*EMBEDDING_COLUMNS)
    if check_unique:
        dup = (rows.groupBy("method", "doc_id").count().filter(F.col("count") > 1)
               .select("method", "doc_id").limit(1).collect())
        if dup:
            raise ValueError(f"duplicate (method, doc_id) in embeddings: {tuple(dup[0])}")
    for m in sorted(r["method"] for r in rows.select("method").distinct().collect()):
        write_version(rows.filter(F.col("method") == m).drop("method"), path, m, replace=mode == "overwrite")


def compact(spark: SparkSession, path: str, method: str) -> int:
    """Fold the live versions of ``method`` into one; readers of the old state keep it."""
    return write_version(read_versions(spark, path, method).select("doc_id", "content_hash", "embedding"),
                         path, method, replace=True)

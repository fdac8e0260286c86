"""Operator 4: token ids written as Parquet list columns, read back selectively.

``write_token_files`` orders the documents by id over the whole table (range
partitions, sorted inside), encodes each partition in one Arrow pass and lets
Spark's Parquet writer commit the files. A file holds, per document,

    doc_id, token_ids array<int>, n_tokens long, start_in_file long

Ids are dictionary encoded by default (a vocabulary of 49 k fits one dictionary
page, so an id takes 16 bits); ``encoding="delta"`` turns the dictionary off and
uses the version 2 writer, whose integers are DELTA_BINARY_PACKED. Row-group
and page sizes are parameters; the writer adds column and offset indexes, so
that a filter on the sorted ``doc_id`` reads only the pages it needs, and a
read of ``n_tokens`` never touches the ids.

A document's place in the whole corpus is its file's base (sums over the files
before it, from the metadata columns alone) plus ``start_in_file``.

Defined cases: a null or empty text holds the end id alone; null ids come
first; rows that share an id keep their own ranges, ordered by text; an empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import lean, list_column, read_table, small_side, text_slices
from quarry.llm.tokens import TOKEN_SLICE_BYTES, with_end, word_tokenizer
from quarry.session import shared_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
PAGE_ROWS = 2_000
#: Files whose bases are broadcast; beyond it the join is a shuffle.
BROADCAST_FILES = 200_000
FILE_SCHEMA = "doc_id long, token_ids array<int>, n_tokens long, start_in_file long"


def _encoder(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = word_tokenizer(tokenizer), 0
        for batch in batches:
            for part in text_slices(batch, "text", TOKEN_SLICE_BYTES):
                ids, counts = with_end(*words.encode(part.column("text")), end_id)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), list_column(ids.astype(np.int32), counts, pa.int32()),
                     pa.array(counts, pa.int64()), pa.array(starts, pa.int64())],
                    ["doc_id", "token_ids", "n_tokens", "start_in_file"])
    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                      encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> str:
    """Write ``docs`` (doc_id, text) as token files in ascending ``doc_id`` order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding must be 'dictionary' or 'delta', not {encoding!r}")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    (ordered.mapInArrow(lean(_encoder(tokenizer, end_id), tokens=True), FILE_SCHEMA).write
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
     .option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes))
     .option("parquet.page.row.count.limit", str(page_rows))
     .option("compression", "zstd")
     .parquet(path))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as written, with the number of the file each row is in."""
    return (spark.read.schema(FILE_SCHEMA).parquet(path)
            .withColumn("file_no", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of a few documents: page indexes on ``doc_id`` skip the rest."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "token_ids")


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, base): ids in all earlier files, from the counts alone. One row per file."""
    sums = read_token_files(spark, path).groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, start): ``start`` counts the ids of all documents before."""
    bases = small_side(file_bases(spark, path), BROADCAST_FILES)
    return (read_token_files(spark, path).join(bases, "file_no")
            .select("doc_id", "token_ids", "n_tokens",
                    (F.col("base") + F.col("start_in_file")).alias("start")))


def ids_crc32(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("token_ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
             pa.array(ids_crc32(flat, bounds - bounds[0]), pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(read_table(spark, sf_dir, "documents"), shared_dir(spark, "llm_token_files"))
    return read_documents(spark, path).mapInArrow(lean(_digest), "doc_id long, start long, n_tokens long, ids_crc32 long")

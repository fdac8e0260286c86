"""CSV and Parquet sources and sinks (O01, O04, O05, O07); the embedding store (O06) is ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quarry.sources.store import found, list_methods, load_embeddings, save_embeddings, store_exists

__all__ = ["is_complete", "list_methods", "load_embeddings", "read_metrics", "read_papers", "read_word_vectors",
           "save_embeddings", "store_exists", "write_metrics", "write_papers", "write_word_vectors"]

PAPERS_SCHEMA = StructType([
    StructField("title", StringType(), False),
    StructField("abstract", StringType(), True),
    StructField("webpage_url", StringType(), False),
    StructField("document_url", StringType(), True),
])

WORD_VECTORS_SCHEMA = StructType([
    StructField("word", StringType(), False),
    StructField("vector", ArrayType(FloatType()), False),
])

# Options that make a CSV round trip lossless: quoted fields may hold
# newlines and doubled quotes, and the writer must not trim.
CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def read_papers(spark: SparkSession, path: str, schema: StructType = PAPERS_SCHEMA) -> DataFrame:
    """CSV with a header row, explicit schema (no inference)."""
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


# Rows of one CSV file: quoted line breaks make a file one read task.
CSV_FILE_ROWS = 200_000


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write lies at ``path`` (its ``_SUCCESS`` mark is there)."""
    return bool(found(spark, f"{path.rstrip('/')}/_SUCCESS"))


def write_papers(df: DataFrame, path: str) -> None:
    """CSV sink, skipped when a complete output already exists; the remains
    of an unfinished write are replaced."""
    if not is_complete(df.sparkSession, path):
        (df.write.mode("overwrite").options(**CSV_WRITE)
         .option("maxRecordsPerFile", str(CSV_FILE_ROWS)).csv(path))


def write_word_vectors(df: DataFrame, path: str) -> None:
    df.select("word", F.col("vector").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """O05."""
    return spark.read.schema(WORD_VECTORS_SCHEMA).parquet(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One report per run, partitioned by method."""
    df.write.mode("overwrite").partitionBy("method").format(fmt).save(path)


def read_metrics(spark: SparkSession, path: str, schema: StructType | None = None,
                 fmt: str = "parquet") -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)

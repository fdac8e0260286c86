"""Loading the given tables and the fixtures derived from them.

Every fixture is a Spark expression over the given tables, so its size
grows with them. The DuckDB oracle derives the same fixtures in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT_TOP_K
from quarry.functions.text import clean_words, explode_values


# Set by ``local_session`` only: partitions into which a given table is dealt.
DEAL = "spark.quarry.local.tablePartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole, as the scan splits it. A test or bench session may
    deal the rows anew (``DEAL``), to use its cores on tables of one row group."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O08 on the given corpus: (doc_id, content)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Benchmark passages as queries: (query_id, query, top_k)."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.lit(int(top_k)).alias("top_k"))


def conversation_queries(spark: SparkSession, sf_dir: str, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Every user turn is a question: (query_id, query, top_k), with
    ``query_id`` = "conversation:turn"."""
    conv = table(spark, sf_dir, "conversations")
    return conv.filter(F.col("role") == "user").select(
        turn_key("turn").alias("query_id"), F.col("text").alias("query"), F.lit(int(top_k)).alias("top_k"))


def turn_key(turn: str):
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col(turn).cast("string"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turns that answer a user turn (the last one before them)
    are its hypothetical answers: (query_id, n, text)."""
    conv = table(spark, sf_dir, "conversations")
    so_far = (Window.partitionBy("conv_id").orderBy("turn")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(so_far)
    return (conv.withColumn("asked", asked)
            .filter((F.col("role") == "assistant") & F.col("asked").isNotNull())
            .select(turn_key("asked").alias("query_id"), F.col("turn").cast("int").alias("n"), "text"))


def md5_word_vectors(words: DataFrame, dims: int = 8) -> DataFrame:
    """Deterministic stand-in word vectors: dim i = i-th hex digit of md5(word)."""
    h = F.md5(F.col("word"))
    vec = F.transform(F.sequence(F.lit(1), F.lit(dims)),
                      lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int"))
    return words.select("word", vec.alias("vector"))


def word_vectors(spark: SparkSession, sf_dir: str, dims: int = 8) -> DataFrame:
    """A pretrained-model stand-in: md5 vectors for every clean word of the
    *conversations* corpus, so documents only partly overlap with the model's
    vocabulary, like a real pretrained model."""
    conv = table(spark, sf_dir, "conversations")
    words = explode_values(conv, clean_words("text"), "word").distinct()
    return md5_word_vectors(words, dims)


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding) from the given embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Every stored vector is also a query against the whole store."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding", F.lit(int(top_k)).alias("top_k"))

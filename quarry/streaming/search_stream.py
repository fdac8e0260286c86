"""The search request path as a Structured Streaming job.

The reference answers one request at a time: a query arrives, the chosen
pipeline runs, a ranked list leaves. Here queries arrive as a stream (any
streaming source with the columns query_id, query, top_k); every
micro-batch is searched as a table against a static corpus whose vectors were
computed once (``get_or_create_embeddings`` / ``load_embeddings``), and the
results are written per epoch. A retried epoch overwrites its own folder, so
the sink is idempotent.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import SearchConfig
from quarry.plans.search import search
from quarry.session import shared_dir

QUERY_SCHEMA = "query_id long, query string, top_k int"


def read_query_stream(spark, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Queries dropped as Parquet files into ``path``."""
    r = spark.readStream.schema(QUERY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def start_search_stream(queries: DataFrame, documents: DataFrame, doc_vectors: DataFrame,
                        config: SearchConfig, make_encoder, output_path: str,
                        checkpoint_location: str | None = None, make_scorer=None,
                        make_generator=None, available_now: bool = False,
                        bm25_index: str | None = None) -> StreamingQuery:
    """Start the stream; results land in ``output_path/epoch=<id>``."""
    spark = queries.sparkSession
    if checkpoint_location is None:
        checkpoint_location = shared_dir(spark, "search_stream")

    def answer(batch: DataFrame, epoch_id: int) -> None:
        res = search(documents, batch, config, make_encoder, doc_vectors=doc_vectors,
                     make_scorer=make_scorer, make_generator=make_generator, bm25_index=bm25_index)
        res.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(
            os.path.join(output_path, f"epoch={epoch_id}"))

    w = (queries.writeStream.foreachBatch(answer)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()

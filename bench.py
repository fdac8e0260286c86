"""Bench: seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with a ``noop`` write (every row computed, nothing sent
to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry import registry  # noqa: E402
from quarry.session import local_session  # noqa: E402

HEADLINE = ["bm25_topk", "tfidf", "cosine_topk", "metrics_per_query",
            "rrf_hybrid", "hyde_topk", "qrels_resolve", "word_vector_embed"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16),
                          app="quarry-bench", deal=int(cpus) if cpus.isdigit() else 8)
    qs = registry.queries()
    # Warm the JVM and Python workers on the smallest fixture.
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        qs["bm25_topk"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    index = {}
    if not sys.argv[1:]:
        # The stored index: built once, then searched (the usual serving shape).
        from quarry.operators import bm25
        from quarry.session import shared_dir
        from quarry.sources import tables as T

        path = shared_dir(spark, "bench_bm25_index")
        t0 = time.perf_counter()
        bm25.build_bm25_index(T.documents(spark, sf_dir), path)
        index["build"] = round(time.perf_counter() - t0, 3)
        for name, qs_ in (("search_all", T.queries(spark, sf_dir)),
                          ("search_one", T.queries(spark, sf_dir).limit(1))):
            t0 = time.perf_counter()
            bm25.bm25_search_index(spark, path, qs_).write.format("noop").mode("overwrite").save()
            index[name] = round(time.perf_counter() - t0, 3)
        print(f"bm25_index: {index}", file=sys.stderr, flush=True)
    for k in keys:
        t0 = time.perf_counter()
        qs[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
        print(f"{k}: {times[k]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "bm25_index": index}))


if __name__ == "__main__":
    main()

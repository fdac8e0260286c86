"""Print the executed (adaptive) plan of registered queries with a summary of
the operators that matter at scale: exchanges, broadcasts, partial top-k,
Python stages, and any cross-join shape.

    python tools/explain.py [--sf DIR] key [key ...]
"""

from __future__ import annotations

import argparse
import re
import sys

sys.path.insert(0, ".")

from quarry import registry  # noqa: E402
from quarry.session import local_session  # noqa: E402

WATCH = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "WindowGroupLimit",
         "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ReusedExchange"]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true", help="print the whole plan")
    ap.add_argument("keys", nargs="+")
    a = ap.parse_args()
    spark = local_session(8)
    qs = registry.queries()
    for k in a.keys:
        df = qs[k](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {w: len(re.findall(rf"\b{w}\b", plan)) for w in WATCH}
        print(f"== {k}: " + ", ".join(f"{w}={n}" for w, n in counts.items() if n))
        for m in sorted(set(re.findall(r"ReadSchema: [^\n,]*(?:,[^\n]*)?", plan)))[:8]:
            print("   ", m[:160])
        if a.full:
            print(plan)


if __name__ == "__main__":
    main()

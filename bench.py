"""Headline queries, one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from lattica.queries import REGISTRY
from lattica.session import local_session

HEADLINE = ["sssp", "sssp_events", "cc_full", "cc_cap20", "lpa_15", "pagerank", "pagerank_personalized", "khop_2", "partition_report", "triplets"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["out_degree"](spark, d).count()  # start the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        REGISTRY[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()

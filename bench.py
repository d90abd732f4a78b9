"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from checks.queries import QUERIES
from passages.session import local_session, ship_with_tasks

HEADLINE = (
    "chunk_fixed",
    "embed_hash",
    "knn_join",
    "bm25_topk",
    "semantic_search",
    "hybrid_search",
    "answer_records",
    "ingest_fixed",
)


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    ship_with_tasks()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "answer_records", os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001"))
    seconds = {name: round(run(spark, name, sf), 3) for name in names}
    scale = re.search(r"sf([0-9.]+)$", sf.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

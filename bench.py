"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully executed with a no-op sink (every row and column is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_fixed",        # P5 over all documents
    "detect_pii",         # A2 over all documents
    "anonymize_map",      # A1-A4 over all documents
    "topk_l2",            # R2 exact dense top-10, every vector as a query
    "topk_sparse",        # R2b: one question per ticket against the SLA index
    "build_index",        # E3/E4: both stores chunked, embedded, persisted
    "pipeline_kb",        # E1 end to end
    "pipeline_sla",       # E2 end to end (the flagship)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from scrubsearch import get_spark
    from scrubsearch.plans import catalog

    spark = get_spark(cpus=cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

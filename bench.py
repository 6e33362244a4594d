"""Headline queries at one scale, one JSON line on standard output.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs per query (after one
untimed run). A query's time is the median of its runs; the sink discards the rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "extractive_digest", "digests", "sentences", "extract_pages_light", "extract_pages_article", "page_metadata", "postings", "search_words",
    "list_library", "cues_from_vtt", "vtt_timing_report", "validate_timing", "core_timeline", "cache_lookup", "duplicate_documents",
    "fold_jobs", "batch_status", "job_view", "validate_requests", "canonical_url", "host_public_check", "ingest_links",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    from digestmill.plans.queries import QUERIES
    from digestmill.session import local_session

    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "digestmill-bench")
    wanted = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: first {taken[0]:.2f}s, median {timings[name]:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    name = Path(sf_dir).name
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": float(name[2:]) if name.startswith("sf") else name,
    }))


if __name__ == "__main__":
    main()

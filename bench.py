"""Benchmark: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

READS = ["q_traces", "q_trace_detail", "q_topology", "q_detections", "q_clock_offsets"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from spanlake.plans import catalog
    from spanlake.session import local_session
    from spanlake.sources import tabular

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    timings: dict[str, float] = {}

    def timed(name, fn):
        begin = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - begin, 3)
        return out

    received = timed("raw_spans", lambda: tabular.raw_spans(spark, sf_dir).count())
    tables = catalog.analysis(spark, sf_dir)
    for step in tables.SHARED:
        timed(step, lambda: getattr(tables, step))
    # The branches run side by side, so their steps overlap in time.
    steps = tables.BRANCHES
    with ThreadPoolExecutor(len(steps)) as pool:
        begin = time.perf_counter()
        list(pool.map(lambda names: [timed(n, lambda: getattr(tables, n)) for n in names], steps))
        timings["branches"] = round(time.perf_counter() - begin, 3)
    total = round(sum(timings[s] for s in (*tables.SHARED, "branches")), 3)
    stored = tables.spans.count()
    catalog.arrivals(spark, sf_dir)  # the stream's input files
    for name in ["stream_ingest", *READS]:
        run = catalog.REGISTRY[name][0]
        timed(name, lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "span_analysis_end_to_end",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "spans_received": received,
                "spans_stored": stored,
                "analysed_spans_per_sec": round(stored / total),
                "ingested_spans_per_sec": round(received / timings["spans"]),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline-query timings. Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Each query runs to
completion through Spark's no-op sink (full execution, nothing pulled to the
driver); one warm-up run of a small query precedes the timings.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsieve.plans.catalog import QUERIES  # noqa: E402
from logsieve.session import local_session  # noqa: E402

HEADLINE = (
    "parse_json", "parse_plain", "rejects", "filter_all", "total_and_range", "report_stats",
    "top_sources", "dominant_level", "month_bars", "merge_sorted", "tail_sample",
    "bundle_prompt", "conversation_bundles", "json_rows", "csv_rows", "normalize",
    "exact_collapse", "trim", "trim_documents",
)
# similar_pairs / trim_report / dedup_summary / preview repeat the document
# trim's work and are checked at sf0.01 by the oracle instead.


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = local_session(cpus, max(8, cpus))
    # JVM / code-generation warm-up on the smallest scale
    QUERIES["level_counts"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    # parse-once staging (rendered event lines -> typed entries; documents ->
    # normalised messages), timed on its own; later queries read the Parquet
    from logsieve.plans import catalog

    for name, fn in (("stage_event_entries", catalog._parsed), ("stage_documents", catalog._docs)):
        t0 = time.perf_counter()
        fn(spark, sf_dir)
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

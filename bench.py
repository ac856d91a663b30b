"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "report_fallback", "report_scope_counts", "marking_counts", "page_quality", "chunk_pages", "classify_documents", "score_chunks",
    "candidate_selection", "resolve_keys", "enrich_canonical", "merge_best", "attest_segments", "dedup_deeds", "json_records", "rag_top_k",
    "import_audit", "case_stats", "target_scope", "stream_job_state", "merge_attest", "merged_evidence", "extract_canonical", "extract_records",
    "report_final",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks.queries import QUERIES
    from deedloom.session import intermediates, local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"))
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.time()
        # the noop sink runs the whole plan and keeps no rows
        with intermediates(spark):
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(out))


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketry.plans import QUERIES  # noqa: E402
from docketry.session import get_spark  # noqa: E402

HEADLINE = (
    "type_counts", "keyword_classify", "signal_classify", "intake_gate", "intake_outcomes", "language_scores", "rule_analysis", "behavior_signals",
    "field_evaluate", "field_validate", "answer_candidates", "supplement_outcomes", "bm25_topk", "dense_topk", "hybrid_retrieve", "pii_residual",
    "learning_export", "chunk_documents", "letters", "route_select", "repeat_applicants", "staff_choice", "assign_batch", "closed_assignments",
    "case_states", "case_changes", "case_list_page", "related_cases", "case_status", "case_trace", "contract_quarantine",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    chosen = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's and the Python workers' machinery.
    QUERIES["type_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()

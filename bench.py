"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from scangrove.plans.queries import QUERIES
from scangrove.session import local_session

HEADLINES = [
    "c1_document_scan", "b10_findings", "c4_suppress_by_rule", "d1_language_breakdown", "d2_risk_score", "c6_checklists",
    "d7_file_rollup", "e4_bundle_packing", "j1_sarif_results", "j3_sarif_document", "k7_context_blocks", "l6_parsed_responses",
    "c11_response_lookup", "d2_order_volume", "n1_stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "16g")
    # Starting the session and the first compilation are not part of any query.
    QUERIES["h3_description_hashes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 2), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

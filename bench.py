"""Time the headline jobs and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [job ...]

Each job is run to the end into the ``noop`` sink, so no rows pass through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.plans import REGISTRY
from plumbline.session import build_session

HEADLINE = [
    "trust_scorecard", "bias_metrics", "confusion_by_group", "subgroup_rates", "top_correlated", "distribution_report",
    "reweighed_rates", "profile_lineitem", "encoded_table", "redacted_documents",
    "executive_kpis_by_tenant", "fairness_drift", "hourly_rate_limits", "triaged_queue", "weight_fold",
    "compliance_rows", "regulatory_flags", "document_claims", "claim_support", "text_truth", "output_audit",
    "dense_neighbours", "permutation_importance", "cluster_gaps", "row_explanations", "stream_kpi_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [a for a in sys.argv[1:] if not a.startswith("-")] or (list(REGISTRY) if "--all" in sys.argv else HEADLINE)
    REGISTRY["trust_scorecard"].run(spark, folder).collect()  # JVM and codegen warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {"metric": "headline jobs, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()

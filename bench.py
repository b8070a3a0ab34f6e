"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "d2_group_counts", "d1_group_entries", "c1_attach_classification", "c2_pending_items", "d4_dedupe_first",
    "a6_upsert_store", "a10_source_fallback", "b1_version_range", "c3_resolve_links", "c5_fold_parts", "c6_nearest_known",
    "d9_batch_payload_sizes", "d10_plan_caps", "d11_ledger_usage", "d12_summary", "d15_cell_metrics", "d16_sweep_table",
    "d21_table_profile", "d22_render_document", "d26_cost_ledger", "e1_sections_of", "e6_peak_in_flight",
    "e7_admit_under_caps", "f4_sample_with_more", "h1_15_result_key", "h6_1_extract_links", "h6_6_html_to_text",
    "i1_reachable", "i2_reading_order", "i3_inherit_up", "j3_budget_ledger", "k1_html_blocks", "k4_score_entries", "k5_rule_scorer",
)


def main() -> None:
    from docloom.plans import load_all
    from docloom.plans.registry import QUERIES
    from docloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    # One small query first, so that no timing holds the start of the session.
    QUERIES["b1_version_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

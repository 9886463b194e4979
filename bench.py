"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from poolspark.plans import load
from poolspark.session import build_session

HEADLINE = [
    "banded_return", "favourite_longshot_by_source", "qualified_first_occurrence", "calibration_buckets",
    "combo_retention_quantiles", "pool_evaluation", "crowd_by_year", "favourite_slip_economics", "strict_fixture_match",
    "price_attachment", "all_or_nothing_price_join", "keep_last_plausible", "positional_enrichment", "slip_enumerate",
    "slip_rule_filter", "covering_reduction", "strategy_scoreboard", "placement_comparison", "config_sweep",
    "category_per_pool", "published_index", "pool_audit", "id_gaps", "resume_guard_runs", "anchor_days",
    "bracket_interpolation", "longest_nondecreasing", "alias_votes", "name_candidates", "market_signature_scan",
    "page_rows_extract", "frames_decode_batch", "stream_keep_plausible",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    queries["banded_return"](spark, sf).count()  # warm the JVM and the file cache once
    times = {}
    for name in wanted:
        start = time.perf_counter()
        # Every row is computed and nothing is sent to the driver.
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

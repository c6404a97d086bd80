"""Times the headline queries, the median of three runs each after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "b26_c01_scan_counts", "b27_scan_independent", "b28_precheck_stats", "c01_c04_mask", "c07_hybrid_text", "c10_collisions",
    "c14_restore", "c21_outbound_gate", "t08_t09_keywords", "t16_summary", "t19_group_summary", "t25_diff_counts",
    "t38_retrieve", "t28_t32_items", "e10_silence_split", "f11_anchor_check", "f18_ref_integrity", "f21_count_agreement",
    "g02_shares_with",
)


WARM_UP, RUNS = ("b05_ip", "t22_keyword_sets", "c10_collisions"), 3


def main() -> None:
    from palimpsest.plans import catalog
    from palimpsest.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    registered, times = catalog.queries(), {}

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in WARM_UP:
        run(name)
    for name in HEADLINE:
        times[name] = round(median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

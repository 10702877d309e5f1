"""Time the headline queries and print one JSON line."""

import json
import os
import time

from surfaudit.plans import load_entries
from surfaudit.session import build_session

HEADLINE = [
    "d02_combine_evidence",       # consensus of correlated views
    "d09_summarize_regions",      # region aggregates
    "d26_average_precision_continuous",
    "d29_histogram_ap",
    "d31_correlations",
    "d34_abstain",
    "d39_fp_burden",              # components and physical area
    "d40_evaluate_policies",
    "c06_sample_support",
    "c09_sample_trilinear",
    "h05_block_bootstrap",
    "i02_components_area",
    "i09_grid_topology",
    "j01_structural_map",
    "j04_patch_features",         # patches against a surface
    "j04_patch_distances",
    "l06_claim_ceiling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_entries()
    entries[HEADLINE[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.time()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

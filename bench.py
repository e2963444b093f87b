"""Time the headline queries over whole tables; prints one JSON line.

Every result is written to the no-op sink, so all columns of all rows are produced. The first query of a session also
pays for loading classes; a small unrelated job runs first so that it does not.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridmend.plans import catalog  # noqa: E402
from gridmend.session import build_session  # noqa: E402

HEADLINE = ["file_stats", "kpis", "statement", "guest_quota", "settle", "review_lifecycle", "standardize_phones_grid", "recode_fixed_choice", "reconcile_totals",
            "drop_non_data_rows", "vote_cells", "vote_name_tokens", "correction_rules"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "gridmend-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
Every query starts without shared schemas, so inference is part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog import queries as q
from tabmend.session import build_session

HEADLINE = (
    "prof_nulls",
    "prof_moments_lineitem",
    "prof_nunique",
    "prof_value_counts",
    "prof_issues",
    "prof_issues_lineitem",
    "prof_issues_events",
    "inf_schema",
    "inf_schema_orders",
    "cln_pipeline",
    "rem_impute_median",
    "rem_gauss_replace",
    "syn_cast_union",
    "pipe_plan",
    "pipe_apply",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    q.QUERIES["prof_nulls"](spark, sf_dir).collect()  # start the executor threads
    times = {}
    for name in names:
        q._spec.cache_clear()
        start = time.perf_counter()
        q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

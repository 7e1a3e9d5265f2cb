"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     cores (default 8)
BENCH_QUERIES  comma-separated names (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import time

from keysift.catalog.queries import QUERIES
from keysift.session import local_session, release_scratch

HEADLINE = (
    "c1_scan",
    "a1_distinct_secrets",
    "a6_count_by_rule",
    "p1_lines",
    "f7_fingerprint",
    "j2_new_content",
    "j2_known_content",
    "c3_package_facts",
    "f8_metadata",
    "w1_last_attachment",
    "c4_reports",
    "c5_chat_messages",
    "c7_scan_batch",
    "t1_incremental_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session is not a query; what follows is none of them.
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy().count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

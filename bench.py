"""Times the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS."""

from __future__ import annotations

import json
import os
import time
from statistics import median


def main() -> None:
    from bytesift.session import session
    from bytesift.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = session(f"local[{cpus}]", int(cpus), spark_ui_enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in QUERIES.items():
        each = []
        for _ in range(runs):
            began = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(min(each) if runs < 3 else median(each[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

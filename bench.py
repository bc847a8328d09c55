"""Times headline queries, each as the median of a few runs, and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ["order_lifecycle", "sweep_clusters", "post_cancel_clusters", "withdrawal_bursts", "level_running_size", "level_check", "protected_bbo", "trade_window_pre_post", "halt_pairs", "large_trades", "robust_stats", "price_path", "wire_decode_roundtrip"]

#: Each query's time is the median of so many runs.
RUNS = 3


def main() -> None:
    from tapewright import session
    from tapewright.plans import registry

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["order_lifecycle"](spark, folder).limit(1).collect()  # starts the JVM's compilers
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):
            with session.noted() as places:
                began = time.time()
                registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                runs.append(time.time() - began)
            session.removed(spark, places)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "where_map_lineitem", "partition_merge_filter", "running_group_sum", "join_theta_orders_customer", "sliding_range_avg_by_user", "windowed_join_events", "cep_seq_first_match",
    "group_final_all_aggs", "tumbling_epoch_agg", "tumbling_anchored_agg", "scale_join_lineitem_supplier", "keyed_table_upsert", "tuplify_events",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from rillstone.plans.catalogue import QUERIES

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Tables are put into
shards before the clock starts; that time is in ``load``. Each query runs once
to warm up and then counts by the better of two runs, all rows read. ``plain``
has the same SQL by Spark alone over the unsharded files.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from shardloom import queries as core

HEADLINE = (
    "route_equal_unique", "route_in", "route_lookup", "route_range_numeric", "agg_sum", "group_order_limit", "distinct_order_limit", "union", "join_collocated",
    "join_cross_inner", "join_cross_keyspace", "join_three_way", "join_semi", "window_rank", "cte", "pricing_summary",
)


def seconds(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    began = time.perf_counter()
    for name in HEADLINE:
        core.engine_for(spark, sf_dir, *core.SQL[name][0].split())
    load = time.perf_counter() - began
    for table in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    took, plain = {}, {}
    for name in HEADLINE:
        run, text = core.sql_query(name), core.SQL[name][1]
        seconds(lambda: run(spark, sf_dir))
        took[name] = round(min(seconds(lambda: run(spark, sf_dir)) for _ in range(2)), 3)
        seconds(lambda: spark.sql(text))
        plain[name] = round(min(seconds(lambda: spark.sql(text)) for _ in range(2)), 3)
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}
    print(json.dumps({**out, "load": round(load, 3), "plain": plain, "plain_total": round(sum(plain.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()

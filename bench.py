"""Time the mart build and the reports on one data set; prints one JSON line.

BENCH_SF_DIR  source directory (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

The tables are written first, as in daily use.  Builds and reports run once to
warm up and three times for the median.  Results go in full to the no-op sink,
so every column is computed.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q01_kpis",
    "q03_kpis_region",
    "q06_vehicles",
    "q10_delay_report",
    "q11_worst_routes",
    "q12_map_stops",
    "q17_cost_by_depot",
    "q22_delay_pivot",
    "e1_cost_by_depot",
    "e2_on_time_by_week",
    "n2_on_time_by_depot_and_week",
    "n3_late_regions_with_reasons",
    "n6_worst_clients_this_quarter",
    "n7_busiest_depots",
    "p1_on_time_by_window",
    "p3_straight_line_efficiency",
    "p4_load_utilization",
    "p8_route_paths",
    "o2_sample_by_rate",
    "o7_dense_id",
    "o9_expand_rows",
    "o10_rank_zip_join",
    "d2_key_checks",
]


def main():
    from pyspark.sql import SparkSession

    from drayage.registry import REPORTS
    from drayage.plans.states import STATES
    from drayage.schemas import TABLES
    from drayage.sources.mart import SourceMart

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action):
        start = time.perf_counter()
        action()
        return time.perf_counter() - start

    reads = dict(zip(TABLES, ["vehicles", "orders", "routes", "stops"]))
    seconds, builds = {}, []
    for _ in range(4):
        mart = SourceMart(spark, directory)
        # the lines meet their orders with the routes, the first table made from them
        builds.append({table: timed(lambda: getattr(mart, read)) for table, read in reads.items()})
        builds[-1] |= {"states": timed(lambda: [mart.state(name) for name in STATES])}
    for table in [*TABLES, "states"]:
        seconds[f"build_{table}"] = statistics.median(build[table] for build in builds[1:])

    def run(name):
        REPORTS[name](mart).write.format("noop").mode("overwrite").save()

    for name in names:
        run(name)
        seconds[name] = statistics.median(timed(lambda: run(name)) for _ in range(3))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "mart build plus headline reports, median of 3 warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": directory.rstrip("/").split("/sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

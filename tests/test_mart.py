"""The derived mart: invariants, hot keys, plans, and every report against SQL."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from drayage import lifecycle
from drayage.plans import charts, dashboard, metrics, planning, quality, states
from drayage.plans.filters import in_period
from drayage.registry import REPORTS
from drayage.sources.mart import Mart, SourceMart, mart_of
from drayage.sources.tables import SOURCE_TABLES
from tests.conftest import DATA
from tests.parity import differences, duck

SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_equals_sql(spark, con, name):
    assert differences(entry_module.queries()[name](spark, DATA), con, SQL[name]) == []


def test_every_report_has_sql():
    assert set(REPORTS) <= set(SQL) and set(REPORTS) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sequences_are_dense_per_route(mart):
    per_route = mart.stops.groupBy("route_no").agg(
        F.count("*").alias("n"), F.min("stop_sequence").alias("lo"), F.max("stop_sequence").alias("hi"),
        F.countDistinct("stop_sequence").alias("u"),
    )
    broken = per_route.join(mart.routes, "route_no", "full").where(
        "n is null or n <> planned_stops or lo <> 1 or hi <> n or u <> n"
    )
    assert broken.isEmpty()


def test_delay_sums_agree(mart):
    delayed = mart.stops.where("delay_minutes > 0").count()
    totals = {
        r.category: r.n for r in dashboard.delay_report(mart).groupBy("category").agg(F.sum("count").alias("n")).collect()
    }
    assert totals == {"by_reason": delayed, "by_month": delayed, "by_region": delayed}


def test_delays_come_from_the_dates(mart):
    late = mart.stops.join(mart.orders.select("order_no", "requested_date"), "order_no").select(
        "delay_minutes", F.datediff(F.col("planned_arrival").cast("date"), "requested_date").alias("days")
    )
    # the planned arrival is on the ship date, or the next day at the end of a long route
    assert late.where("delay_minutes > 0 and days <= 0").isEmpty() and not late.where("delay_minutes > 15").isEmpty()
    assert late.where("delay_minutes > 0 and delay_minutes * 30 > days").isEmpty()


def test_mart_does_not_depend_on_hot_paths(spark, mart):
    spark.conf.set("spark.drayage.hotRows", "5")
    try:
        other = SourceMart(spark, DATA)
        assert other.heavy["stops", "route_no"] and other.heavy["stops", "order_no"] and other.heavy["sources", "part_no"]
        assert other.buckets("route_stops") is None and other.buckets("route_plans")
        for table in ("orders", "routes", "stops"):
            assert getattr(other, table).exceptAll(getattr(mart, table)).isEmpty()
            assert getattr(other, table).count() == getattr(mart, table).count()
        for report in (planning.route_load, planning.straight_line_efficiency, planning.route_paths, dashboard.map_stops,
                       dashboard.delay_report, dashboard.kpis):
            assert sorted(map(str, report(other).collect())) == sorted(map(str, report(mart).collect()))
    finally:
        spark.conf.unset("spark.drayage.hotRows")


def test_mart_is_built_once_and_again_for_new_files(spark, mart, tmp_path):
    assert mart_of(spark, DATA) is mart
    source = str(tmp_path)
    for t in SOURCE_TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{source}/{t}.parquet")
    first = mart_of(spark, source)
    assert mart_of(spark, source) is first
    spark.read.parquet(f"{DATA}/supplier.parquet").limit(3).write.mode("append").parquet(f"{source}/supplier.parquet")
    assert mart_of(spark, source) is not first


def test_region_filter_is_a_semi_join(mart):
    assert "LeftSemi" in plan_of(dashboard.kpis(mart, region="ASIA"))
    assert "LeftSemi" in plan_of(dashboard.kpis_of_routes(mart, region="ASIA"))


def test_date_filter_prunes_months_of_both_tables(mart, stored):
    plan = plan_of(dashboard.kpis_of_routes(stored, start="1996-02-01", end="1996-03-31"))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*route_month[^\]]*>= 1996-02", plan)) >= 2
    mart.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(dashboard.kpis_of_routes(mart, start="1996-02-01", end="1996-03-31"))
    mart.spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(re.findall(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(route_month,1996-02\)", plan)) >= 2


def test_months_are_told_apart_by_order(spark, mart):
    """Buckets are sorted by route number, which begins with the month."""
    for name in ("route_stops", "route_plans"):
        rows = spark.table(f"{mart.database}.{name}").select("route_no", "route_month", F.input_file_name().alias("f"))
        per_file = {}
        for r in rows.collect():
            per_file.setdefault(r.f, []).append((r.route_no, r.route_month))
        assert len(per_file) <= mart.buckets(name)
        for own in per_file.values():
            assert own == sorted(own) and [m for _, m in own] == sorted(m for _, m in own)


def test_reports_read_only_their_columns(mart):
    plan = plan_of(metrics.cost_by_depot(mart))
    assert "ReadSchema: struct<depot_id:string,planned_stops:bigint,actual_cost_usd:decimal(18,2)>" in plan


@pytest.fixture
def sort_joins(spark):
    """Joins as they are where no side is small enough to send around."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanged_by(plan, column):
    return re.findall(rf"Exchange hashpartitioning\({column}#", plan)


@pytest.fixture(scope="module")
def stored(spark, mart):
    """The mart as a build has stored it in the catalog."""
    schema = f"stored_{mart.database}"
    lifecycle.build(spark, DATA, schema)
    yield lifecycle.open_mart(spark, schema, mart.depots)
    lifecycle.drop(spark, schema)


def test_routes_and_stops_meet_without_moving(mart, stored, sort_joins):
    small = F.broadcast(mart.vehicles.select("vehicle_no", "vehicle_type"))
    for m in (mart, stored):
        for name, report in {
            "q10": dashboard.delay_report,
            "p3": planning.straight_line_efficiency,
            "p12": planning.route_progress,
            "q11": dashboard.worst_routes,
            "kpis": dashboard.kpis_of_routes,
        }.items():
            assert not exchanged_by(plan_of(report(m)), "route_no"), name
        # the vehicles' side is what it is; routes and stops stay where they are
        known = Mart(m.depots, small, m.orders, m.routes, m.stops, heavy={})
        assert not exchanged_by(plan_of(planning.route_paths(known)), "route_no")


def test_routes_and_stops_are_made_from_served_lines_where_they_lie(spark, mart, sort_joins):
    assert not exchanged_by(plan_of(mart.plan("route_stops")), "route_no")
    assert not exchanged_by(plan_of(mart.plan("route_plans")), "route_no")


def test_asking_for_a_report_starts_no_job(spark, mart):
    # the life of a catalog is jobs; numbering counts its ranges
    asked = {n: r for n, r in REPORTS.items() if not re.match("s[3-9]_|s10_|o7_|o10_", n) or n == "s3_table_scan"}
    for report in asked.values():
        report(mart)  # the tables and states it needs are there now
    tracker, group = spark.sparkContext.statusTracker(), "asking"
    spark.sparkContext.setJobGroup(group, "asking for reports")
    try:
        for name, report in asked.items():
            report(mart)
            assert not tracker.getJobIdsForGroup(group), name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_reports_over_states_equal_those_over_tables(spark, mart):
    filters = [{}, {"start": "1996-02-01", "end": "1997-05-31"}, {"depot": "DEPOT_NATION_3"}, {"region": "ASIA"},
               {"start": "1997-01-01", "depot": "DEPOT_NATION_7", "region": "EUROPE"}, {"depot": "nowhere"}]
    for f in filters:
        assert dashboard.kpis(mart, **f).collect() == dashboard.kpis_of_routes(mart, **f).collect(), f
    for f in ({}, {"start": "1996-02-01", "end": "1997-05-31"}, {"region": "ASIA"}):
        facts, states = dashboard.delay_facts(mart, **f), dashboard.delay_states(mart, **f)
        keys = ["delay_reason", "month", "service_region"]
        direct = facts.groupBy(*keys).agg(F.count("*").alias("stops"), F.sum("delay_minutes").alias("minutes"))
        summed = states.groupBy(*keys).agg(F.sum("stops").alias("stops"), F.sum("minutes").alias("minutes"))
        assert direct.count() == summed.count() and direct.exceptAll(summed).isEmpty()
    done = metrics.completed(mart).agg(F.count("*"), F.sum(F.expr("int(delay_minutes = 0)"))).first()
    sums = mart.state("stop_states").agg(F.sum("completed"), F.sum("completed_on_time")).first()
    assert tuple(done) == tuple(sums)
    for report in (dashboard.kpis, dashboard.delay_report, metrics.on_time_rate, metrics.late_rate, metrics.on_time_by_week,
                   charts.efficiency_trend, charts.delay_pivot, metrics.delay_reasons_by_region):
        assert "route_stops" not in plan_of(report(mart)), report.__name__


@pytest.mark.parametrize("period", [("1995-01-01", "2001-12-31"), ("1996-03-01", "1996-03-31"), ("1997-02-01", "1998-11-30"), ("2030-01-01", None)])
def test_vehicle_bitmaps_count_exactly(mart, period):
    start, end = period
    routes = in_period(mart.routes, "route_date", "route_month", start, end)
    bitmaps = in_period(mart.state("vehicle_bitmaps"), "route_date", "route_month", start, end)
    assert states.distinct_vehicles(bitmaps).first().used == routes.select("vehicle_no").distinct().count()
    plan = plan_of(metrics.fleet_utilization(mart, start=start, end=end))
    assert "vehicle_bitmaps" in plan and "route_plans" not in plan


def test_vehicle_bitmaps_over_several_rows(spark, mart):
    wide = mart.routes.withColumn("vehicle_no", F.col("vehicle_no") * 100_003)
    bitmaps = states.vehicle_bitmaps(Mart(None, mart.vehicles, None, wide, None))
    assert bitmaps.select("bucket").distinct().count() > 3
    assert states.distinct_vehicles(bitmaps).first().used == wide.select("vehicle_no").distinct().count()


def scanned_rows(df):
    """Rows that the parquet scans of a query hand on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, queue = [], [plan]
    while queue:
        node = queue.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            queue.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            queue.append(node.plan())
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith("Scan parquet"):
            found.append((node.nodeName(), node.metrics().apply("numOutputRows").value()))
    return found


def test_a_box_reads_the_row_groups_that_meet_it(spark, mart):
    box = (25.0, -110.0, 35.0, -90.0)
    everything = dashboard.map_stops(mart)
    found = dashboard.map_stops(mart, box=box)
    inside = everything.where("lat between 25 and 35 and lon between -110 and -90")
    assert found.exceptAll(inside).isEmpty() and found.count() == inside.count() > 0
    # a table of one month and many files, as a large one has
    month = mart.state("stop_places").where("route_month = '1997-03'")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/places-{mart.database}"
    month.repartitionByRange(12, "place", "route_no", "stop_sequence").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    in_box = dashboard._near(stored, box)
    read = sum(n for _, n in scanned_rows(in_box.agg(F.count("*"))))
    assert in_box.count() <= read < stored.count() / 2


def test_place_keys_keep_neighbours_together(spark):
    points = spark.sql("SELECT 10.0D + x AS lat, 20.0D + y AS lon FROM range(0, 64) a(x), range(0, 64) b(y)")
    keyed = points.withColumn("place", states.place_key(F.col("lat"), F.col("lon")))
    assert keyed.select("place").distinct().count() == 64 * 64
    want = {}
    for r in keyed.collect():
        cells = [int((r.lat + 90) / 180 * 65536), int((r.lon + 180) / 360 * 65536)]
        want[r.lat, r.lon] = sum((cells[0] >> i & 1) << (2 * i + 1) | (cells[1] >> i & 1) << (2 * i) for i in range(16))
    assert {(r.lat, r.lon): r.place for r in keyed.collect()} == want


def test_each_table_is_scanned_once_for_the_key_ledger(mart):
    plan = plan_of(quality.key_checks(mart))
    for table in ("vehicles", "delivery_orders", "route_plans", "route_stops"):
        assert len(re.findall(rf"FileScan parquet [^\[]*\.{table}\[", plan)) == 1, table
    assert "Join" not in plan.replace("BroadcastHashJoin [n_regionkey", "")


def test_top_k_needs_no_global_sort(mart):
    assert "TakeOrderedAndProject" in plan_of(dashboard.routes(mart, cap=200))
    assert "TakeOrderedAndProject" in plan_of(dashboard.worst_routes(mart))


def test_no_report_uses_a_cross_join_or_python(spark, mart):
    for name, report in REPORTS.items():
        if re.match("s[5-9]_", name):
            continue  # these write schemas and return what they did
        plan = plan_of(report(mart))
        assert "CartesianProduct" not in plan and "Python" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name

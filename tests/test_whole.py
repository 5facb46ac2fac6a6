"""Nothing is dropped: unknown references, long routes, late days, full lists."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from drayage import fixed_values as fv
from drayage.functions import costing
from drayage.plans import building_blocks as blocks
from drayage.plans import charts, dashboard, metrics, planning, quality, questions
from drayage.registry import REPORTS
from drayage.sources import mart as builders
from tests.test_mart import plan_of


def partly_known(mart):
    """The mart with two suppliers, some customers and a nation taken out of the sources."""
    depots = mart.depots_by_nation.where("n_nationkey <> 3")
    places = builders.dimensions.depot_table(depots)
    lines, orders = mart.source("lineitem"), mart.source("orders")
    vehicles = builders.build_vehicles(mart.source("supplier").where("s_suppkey > 2"), depots)
    placed = builders.build_orders(orders, mart.source("customer").where("c_custkey > 5"), lines, mart.source("part"), depots)
    served = builders.serve(lines, placed)
    routes = builders.build_routes(served, vehicles, places)
    return builders.Mart(places, vehicles, placed, routes, builders.build_stops(served, routes))


def test_unknown_supplier_customer_and_nation_keep_every_row(mart):
    part, orders = partly_known(mart), mart.source("orders")
    known = mart.source("supplier").where("s_suppkey > 2")
    assert part.vehicles.count() == known.count() < mart.source("supplier").count()
    assert part.vehicles.where("depot_id is null").count() == known.where("s_nationkey = 3").count()
    assert part.orders.count() == orders.count()
    assert part.orders.where("client_id is null").count() == orders.where("o_custkey <= 5").count() > 0
    assert part.routes.agg(F.sum("planned_stops")).first()[0] == mart.source("lineitem").count()
    assert part.routes.where("depot_id is null").count() > 0
    assert part.routes.join(part.vehicles, "vehicle_no", "left_anti").count() > 0
    assert part.stops.count() == mart.source("lineitem").count()
    checks = {r["check"]: r["rows"] for r in quality.key_checks(part).collect()}
    assert checks["route_plans.vehicle_id"] > 0
    assert checks["delivery_orders.depot_id is null"] == part.orders.where("depot_id is null").count() > 0
    assert checks["route_plans.depot_id is null"] == part.routes.where("depot_id is null").count() > 0
    assert checks["vehicles.depot_id is null"] == part.vehicles.where("depot_id is null").count()


def test_reports_keep_routes_of_unknown_vehicles(mart):
    part = partly_known(mart)
    routes, total = part.routes.count(), lambda df, c: df.agg(F.sum(c)).first()[0]
    assert planning.load_utilization(part).count() == routes
    assert total(planning.utilization_heatmap(part), "routes") == routes
    assert total(planning.capacity_by_type(part), "routes") == routes
    assert total(metrics.routes_by_type(part), "routes") == routes
    assert total(questions.busiest_depots(part, n=1000), "routes") == routes
    assert total(questions.busiest_depots(part, n=1000), "stops") == part.stops.count()
    located = part.stops.where("order_found and destination_lat is not null")
    assert planning.route_paths(part).select(F.sum(F.size("points"))).first()[0] == located.count()
    assert total(blocks.weighted_demand(part), "orders") == part.orders.count()
    assert total(blocks.demand_grid(part), "orders") == part.orders.count()
    assert total(dashboard.delays_by_region(part), "count") == part.stops.where("delay_minutes > 0").count()


def test_long_routes_run_on_into_the_next_day(spark):
    stops = spark.range(1, 301).withColumn("offset", costing.minutes_into_route(F.col("id"), F.lit(2400).cast("decimal(18,1)"), F.lit(300)))
    offsets = [r.offset for r in stops.orderBy("id").collect()]
    assert offsets == sorted(offsets) and offsets[-1] == 2400


def test_full_lists_by_default(mart):
    assert dashboard.routes(mart).count() == mart.routes.count() > 200
    assert dashboard.map_stops(mart).count() == mart.stops.join(mart.orders, "order_no").count()
    assert charts.efficiency_trend(mart).count() == mart.routes.select("route_date").distinct().count() > 12


def test_windows_are_of_the_requested_day(spark):
    stops = spark.sql(
        "SELECT * FROM VALUES (1, 1L, timestamp_ntz '2024-01-01 09:30:00'), (2, 1L, timestamp_ntz '2024-01-02 09:30:00'),"
        " (3, 1L, timestamp_ntz '2024-01-02 00:10:00'), (4, 1L, timestamp_ntz '2024-01-01 08:00:00') AS t(route_stop_id, order_no, actual_arrival)"
    )
    orders = spark.sql(
        "SELECT 1L AS order_no, 'c' AS client_id, date '2024-01-01' AS requested_date, 540 AS window_start_min, 600 AS window_end_min"
    )
    small = builders.Mart(None, orders, orders, orders, stops)
    assert planning.on_time_by_window(small).first().on_time_rate == 25.0
    assert planning.late_by_window(small).first().late_rate == 50.0


def test_route_stops_read_one_month(mart):
    route = mart.routes.first().route_id
    plan = plan_of(dashboard.route_stops(mart, route))
    assert "EqualTo(route_id," in plan and "route_month#" in plan


def test_averages_do_not_depend_on_partitions(mart):
    def shuffled(n):
        return builders.Mart(mart.depots, mart.vehicles, mart.orders, mart.routes.repartition(n), mart.stops)

    assert metrics.cost_by_depot(shuffled(1)).collect() == metrics.cost_by_depot(shuffled(200)).collect()


def test_unknown_reasons_and_outcomes_are_counted(mart):
    odd = mart.stops.withColumn("delay_reason", F.when(F.col("delay_minutes") > 20, "flood").otherwise(F.col("delay_reason")))
    odd = odd.withColumn("status", F.when(F.col("stop_sequence") == 1, "lost").otherwise(F.col("status")))
    changed = builders.Mart(mart.depots, mart.vehicles, mart.orders, mart.routes, odd)
    assert charts.delay_pivot(changed).agg(F.sum("other")).first()[0] == odd.where("delay_reason = 'flood'").count()
    assert planning.route_progress(changed).agg(F.sum("other")).first()[0] == mart.routes.count()


NUMBERS = [*range(60), 5, 1234, None]  # 5 comes twice, one vehicle has no number


def own_fleet(spark):
    """A mart of vehicles alone, without routes."""
    supplier = spark.createDataFrame([(n, 1, 10.0) for n in NUMBERS], "s_suppkey long, s_nationkey long, s_acctbal double")
    depots = spark.createDataFrame([(1, "DEPOT_A")], "n_nationkey long, depot_id string")
    routes = spark.createDataFrame([], "vehicle_no long, actual_miles decimal(18,1), actual_cost_usd decimal(18,2)")
    return builders.Mart(None, builders.build_vehicles(supplier, depots), None, routes, None)


def own_share(n, salt):
    return 90 + drawn(n, salt) % 20


def drawn(n, salt):
    return int(hashlib.md5(f"VH-{n:03d}|{salt}".encode()).hexdigest()[:8], 16)


def own_rate(n, column, salt):
    """In cents, half a cent upwards."""
    return (int(fv.VEHICLE_TYPES[n % 6][column] * 100) * own_share(n, salt) + 50) // 100


def own_fuel(n):
    draw = drawn(n, "fuel") % 10
    return "electric" if draw < 2 else "hybrid" if draw == 2 else fv.VEHICLE_TYPES[n % 6][4]


def test_cost_per_mile_has_the_fuels_of_the_vehicles(spark):
    rates = defaultdict(list)
    for n in NUMBERS[:-1]:
        rates[fv.VEHICLE_TYPES[n % 6][0], own_fuel(n)].append(own_rate(n, 5, "cpm"))
    report = planning.cost_per_mile_by_fuel(own_fleet(spark)).collect()
    found = {(r.vehicle_type, r.fuel_type): (r.vehicles, r.avg_cost_per_mile) for r in report}
    assert found.pop((None, None)) == (1, None)
    assert set(found) == set(rates) and {fuel for _, fuel in found} == set(fv.FUEL_TYPES)
    for key, cents in rates.items():
        assert found[key][0] == len(cents) and abs(found[key][1] - sum(cents) / len(cents) / 100) <= 0.005 + 1e-9


def test_vehicles_have_figures_of_their_own(spark):
    found = Counter(
        (r.vehicle_no, r.vehicle_type, r.capacity_weight_lbs, r.capacity_volume_cuft, r.fuel_type,
         r.cost_per_mile_usd and int(r.cost_per_mile_usd * 100), r.daily_fixed_cost_usd and int(r.daily_fixed_cost_usd * 100))
        for r in REPORTS["t1_vehicles"](own_fleet(spark)).collect()
    )
    expected = Counter({(None,) * 7: 1})
    for n in NUMBERS[:-1]:
        kind, weight, volume = fv.VEHICLE_TYPES[n % 6][:3]
        capacity = weight * own_share(n, "cap_wt") // 100, volume * own_share(n, "cap_vol") // 100
        expected[(n, kind, *capacity, own_fuel(n), own_rate(n, 5, "cpm"), own_rate(n, 6, "fixed"))] += 1
    assert found == expected


def test_cost_by_type_averages_the_vehicles_own_rates(spark):
    vehicles = own_fleet(spark).vehicles
    routes = spark.sql("SELECT * FROM VALUES (5L, 1.0BD, 2.0BD), (5L, 3.0BD, 4.0BD), (7L, 1.0BD, 2.0BD) AS t(vehicle_no, actual_miles, actual_cost_usd)")
    report = REPORTS["q20_cost_by_type"](builders.Mart(None, vehicles, None, routes, None)).collect()
    found = {r.vehicle_type: (r.avg_cost_per_mile, r.total_routes) for r in report}
    rates = defaultdict(list)
    for n in NUMBERS[:-1]:
        rates[fv.VEHICLE_TYPES[n % 6][0]].append(own_rate(n, 5, "cpm"))
    assert set(found) == {*rates, None} and found[None] == (None, 0)
    for kind, cents in rates.items():
        assert abs(found[kind][0] - sum(cents) / len(cents) / 100) <= 0.005 + 1e-9
    # number 5 comes twice, and both rows have its two routes
    assert {kind: n for kind, (_, n) in found.items() if n} == {"flatbed": 4, "box_truck": 1}

"""The single operators, each applied to whole tables of the source or mart."""

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from drayage import fixed_values as fv
from drayage.functions import costing
from drayage.functions.calendar import calendar_weight, time_of_day
from drayage.functions.draws import format_id, hash_bucket
from drayage.functions.metrics import haversine_miles, percent
from drayage.operators.numbering import dense_id, first_n, rank_zip_join
from drayage.operators.rows import date_spine, expand_rows, sample_by_rate
from drayage.plans.planning import with_vehicle
from drayage.sources import dimensions


def vehicle_type_dimension(mart) -> DataFrame:
    """The literal vehicle classes with the number of vehicles of each."""
    counts = mart.vehicles.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("vehicles"))
    return dimensions.vehicle_types(mart.spark).join(counts, "vehicle_type", "left").select(
        "vehicle_type",
        "base_weight_lbs",
        "base_volume_cuft",
        "max_stops_per_route",
        "usual_fuel",
        F.coalesce("vehicles", F.lit(0)).alias("vehicles"),
    )


def orders_per_day(mart) -> DataFrame:
    """Every day between the first and last order, with its orders (0 if none)."""
    orders = mart.source("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    bounds = orders.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    counts = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    return date_spine(bounds, "first", "last").select("day").join(counts, "day", "left").fillna(0, ["orders"])


def customer_scan(mart) -> DataFrame:
    return mart.source("customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def order_buckets(mart) -> DataFrame:
    return mart.source("orders").select("o_orderkey", hash_bucket("o_orderkey", "part", 16).alias("bucket"))


def sampled_orders(mart) -> DataFrame:
    """Orders kept with a probability that depends on their priority."""
    rate = F.lit(Decimal("0"))
    for priority, share in fv.PRIORITY_RATES.items():
        rate = F.when(F.col("o_orderpriority") == priority, F.lit(share)).otherwise(rate)
    orders = mart.source("orders").select("o_orderkey", "o_orderpriority")
    return sample_by_rate(orders, "o_orderkey", rate)


def status_shares(mart) -> DataFrame:
    """How the orders of each priority divide into statuses."""
    counts = mart.orders.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("orders"))
    totals = counts.groupBy("priority").agg(F.sum("orders").alias("total"))
    return counts.join(totals, "priority").select("priority", "status", "orders", percent("orders", "total").alias("share_pct"))


def weighted_demand(mart) -> DataFrame:
    """Orders and their calendar weight per depot class and month; orders without a depot have no class."""
    orders = mart.orders.select("depot_id", "requested_date", "requested_month")
    weight = calendar_weight(F.col("requested_date"), F.col("depot_class"))
    return (
        orders.join(mart.depots.select("depot_id", "depot_class"), "depot_id", "left")
        .groupBy("depot_class", "requested_month")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(weight.cast("decimal(12,5)")).alias("weight"))
    )


def demand_grid(mart) -> DataFrame:
    """Orders per depot, month and client; combinations without orders count 0.

    Orders without a depot or client have cells of their own beside the grid.
    """
    states = mart.state("order_states")
    span = states.agg(F.min("requested_month").alias("first"), F.max("requested_month").alias("last"))
    day = lambda name: F.to_date(F.concat(F.col(name), F.lit("-01")))
    months = span.select(F.sequence(day("first"), day("last"), F.expr("interval 1 month")).alias("all")).scalar()
    cells = mart.depots.select("depot_id").withColumn("month", F.explode(months))
    cells = cells.select("depot_id", F.date_format("month", "yyyy-MM").alias("requested_month"))
    # the clients that the data have, as one array
    clients = mart.clients.agg(F.array_sort(F.collect_set("client_id")).alias("all")).scalar()
    cells = cells.withColumn("client_id", F.explode(clients))
    keys = ["depot_id", "requested_month", "client_id"]
    counts = states.groupBy(*keys).agg(F.sum("orders").alias("orders"))
    return cells.join(counts, keys, "full").fillna(0, ["orders"])


def price_spread(mart) -> DataFrame:
    """How far the unit prices paid for each part lie from its retail price, in percent."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    paid = mart.source("lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.min(unit).alias("lowest"), F.max(unit).alias("highest")
    )
    away = lambda price: F.round((F.col(price) / F.col("p_retailprice") - 1) * 100, 2)
    return mart.source("part").select("p_partkey", "p_retailprice").join(paid, "p_partkey").select(
        "p_partkey", "lines", away("lowest").alias("lowest_pct"), away("highest").alias("highest_pct")
    )


def customer_places(mart) -> DataFrame:
    """Customers at the depot of their nation, and how far that is from the middle of its region's depots."""
    depots = mart.depots_by_nation
    middle = depots.groupBy("service_region").agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"))
    placed = depots.join(middle, "service_region").withColumnRenamed("n_nationkey", "c_nationkey")
    miles = F.round(haversine_miles("lat", "lon", "mid_lat", "mid_lon"), 3)
    customers = mart.source("customer").select("c_custkey", "c_nationkey")
    return customers.join(placed, "c_nationkey", "left").select("c_custkey", "depot_id", "lat", "lon", miles.alias("miles_from_middle"))


def numbered_orders(mart) -> DataFrame:
    """Gap-free order numbers by date and key."""
    orders = mart.source("orders").select("o_orderkey", "o_orderdate")
    return dense_id(orders, ["o_orderdate", "o_orderkey"], "ORD-", 6, "order_no").select("o_orderkey", "order_no")


def first_vehicles(mart, n: int = 40) -> DataFrame:
    vehicles = mart.vehicles.select("depot_id", "vehicle_type", "vehicle_id")
    return first_n(vehicles, ["depot_id", "vehicle_type", "vehicle_id"], n)


def planned_stop_slots(mart) -> DataFrame:
    """One row per planned stop of every route."""
    routes = mart.routes.select("route_id", "planned_stops")
    return expand_rows(routes, "planned_stops", "stop_sequence").select("route_id", "stop_sequence")


def order_assignment(mart) -> DataFrame:
    """The k-th stop of a depot and month takes the k-th order requested there."""
    stops = mart.stops.select("depot_id", "route_month", "route_no", "stop_sequence", "route_stop_id")
    orders = mart.orders.select("depot_id", F.col("requested_month").alias("route_month"), "order_no", "order_id")
    paired = rank_zip_join(stops, orders, ["depot_id", "route_month"], ["route_no", "stop_sequence"], ["order_no"])
    return paired.select("route_stop_id", "depot_id", "route_month", "pair_no", "order_id")


def customer_labels(mart) -> DataFrame:
    """Customers with a label and what is known of their address: name and nation."""
    nations = mart.source("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = mart.source("customer").select("c_custkey", "c_name", "c_nationkey").join(nations, "c_nationkey", "left")
    address = F.concat("c_name", F.lit(", "), "n_name")
    return customers.select(format_id("CU-", F.col("c_custkey"), 3).alias("customer_id"), address.alias("address"))


def window_hours(mart) -> DataFrame:
    """Orders per delivery window, rendered from the minutes of the day."""
    return mart.orders.groupBy(
        time_of_day(F.col("window_start_min")).alias("opens"), time_of_day(F.col("window_end_min")).alias("closes")
    ).agg(F.count(F.lit(1)).alias("orders"))


def package_profiles(mart) -> DataFrame:
    """Weight and volume of the orders of each client."""
    weight = F.col("package_weight_lbs")
    return mart.orders.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(weight).alias("weight_lbs"),
        F.min(weight).alias("lightest"),
        F.max(weight).alias("heaviest"),
        F.sum("package_volume_cuft").alias("volume_cuft"),
    )


def planned_costs(mart) -> DataFrame:
    """Planned cost recomputed from its parts, per vehicle class."""
    routes = with_vehicle(mart, mart.routes, "vehicle_type", "cost_per_mile_usd", "daily_fixed_cost_usd")
    cost = costing.plan_cost(
        F.col("daily_fixed_cost_usd"), F.col("planned_miles"), F.col("cost_per_mile_usd"), F.col("planned_stops")
    )
    return routes.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("routes"), F.sum(cost).alias("planned_cost_usd"))


def planned_durations(mart) -> DataFrame:
    """Planned minutes recomputed from stops and miles, per depot."""
    miles = F.coalesce("planned_miles", F.lit(0).cast("decimal(18,1)"))
    minutes = costing.plan_duration(F.col("planned_stops"), fv.STOP_MINUTES, miles)
    return mart.routes.groupBy("depot_id").agg(
        F.count(F.lit(1)).alias("routes"), F.sum(minutes).alias("planned_duration_min")
    )


def actuals_by_method(mart) -> DataFrame:
    """Miles, minutes and cost as planned and as they were, per way of laying out."""
    columns = ["planned_miles", "actual_miles", "planned_duration_min", "actual_duration_min", "planned_cost_usd", "actual_cost_usd"]
    return mart.routes.groupBy("optimization_method").agg(*[F.sum(c).alias(c) for c in columns])


def arrival_hours(mart) -> DataFrame:
    """Stops per planned hour of day, with their lag and dwell in seconds."""
    seconds = lambda later, earlier: F.timestamp_diff("SECOND", F.col(earlier), F.col(later))
    return mart.stops.groupBy(F.hour("planned_arrival").alias("hour")).agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum(seconds("actual_arrival", "planned_arrival")).alias("lag_seconds"),
        F.sum(seconds("actual_departure", "actual_arrival")).alias("dwell_seconds"),
    )


def delays_observed(mart) -> DataFrame:
    """Stops, minutes and extremes of delay per reason; stops without a reason are one row."""
    return mart.stops.groupBy(F.col("delay_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("delay_minutes").alias("minutes"),
        F.min("delay_minutes").alias("shortest"),
        F.max("delay_minutes").alias("longest"),
    )


def stop_targets(mart) -> DataFrame:
    """Stops to plan for every vehicle: its average so far, within the limit of its class."""
    driven = mart.routes.groupBy("vehicle_no").agg(
        F.count(F.lit(1)).alias("routes"), F.sum("planned_stops").alias("stops")
    )
    fleet = mart.vehicles.join(driven, "vehicle_no", "left").fillna(0, ["routes"])
    target = costing.stop_target(F.col("max_stops_per_route"), F.col("stops") / F.col("routes"))
    return fleet.select("vehicle_id", "max_stops_per_route", "routes", target.alias("stop_target"))


def driver_assignments(mart) -> DataFrame:
    """Routes, depots and months per driver."""
    return mart.routes.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("routes"),
        F.countDistinct("depot_id").alias("depots"),
        F.countDistinct("route_month").alias("months"),
    )

"""Reports from the requirements text: windows, distances, loads, progress."""

from pyspark.sql import DataFrame, Window, functions as F

from drayage import fixed_values as fv
from drayage.functions.costing import after
from drayage.functions.metrics import count_if, haversine_miles, mean, percent, ratio
from drayage.operators.joins import lookup_join
from drayage.operators.numbering import previous_row
from drayage.plans.filters import ROUTE_KEY, delayed, selected, selected_routes

PATH_PIECE = 500


def _arrivals(mart) -> DataFrame:
    """Arrival of each stop next to its order's window on the requested day."""
    arrivals = mart.stops.where(F.col("actual_arrival").isNotNull()).select("route_stop_id", "order_no", "actual_arrival")
    day = F.col("requested_date").cast("timestamp_ntz")
    windows = mart.orders.select(
        "order_no",
        "client_id",
        after(day, F.col("window_start_min")).alias("opens"),
        after(day, F.col("window_end_min")).alias("closes"),
    )
    return lookup_join(arrivals, windows, "order_no", hot=mart.hot("stops", "order_no"))


def on_time_by_window(mart) -> DataFrame:
    """Stops that arrive on the requested day within the customer's window, per client."""
    within = F.col("actual_arrival").between(F.col("opens"), F.col("closes"))
    return (
        _arrivals(mart)
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("stops"), percent(count_if(within), F.count(F.lit(1))).alias("on_time_rate"))
        .orderBy("client_id")
    )


def late_by_window(mart) -> DataFrame:
    """Stops that arrive after the customer's window has closed, that day or later, per client."""
    late = F.col("actual_arrival") > F.col("closes")
    return (
        _arrivals(mart)
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("stops"), percent(count_if(late), F.count(F.lit(1)), 3).alias("late_rate"))
        .orderBy("client_id")
    )


def _points(mart) -> DataFrame:
    """The place of every stop that has one."""
    found = mart.stops.where("order_found and destination_lat is not null and destination_lon is not null")
    return found.select(*ROUTE_KEY, "stop_sequence", F.col("destination_lat").alias("lat"), F.col("destination_lon").alias("lon"))


def straight_line_efficiency(mart) -> DataFrame:
    """Straight-line miles between successive stops against driven miles.

    A route with a single located stop has no leg and gets no ratio.  Legs are summed
    as decimals, so the sum does not depend on the order of rows.
    """
    legs = previous_row(_points(mart), ROUTE_KEY, ["stop_sequence"], ["lat", "lon"], hot=mart.hot("stops", "route_no"))
    leg = haversine_miles("prev_lat", "prev_lon", "lat", "lon").cast("decimal(18,9)")
    miles = legs.where(F.col("prev_lat").isNotNull()).groupBy(*ROUTE_KEY).agg(F.sum(leg).alias("straight"))
    return mart.routes.join(miles, ROUTE_KEY, "left").select(
        "route_id",
        F.round("straight", 3).cast("double").alias("straight_miles"),
        F.col("actual_miles").cast("double").alias("actual_miles"),
        F.round(ratio("straight", "actual_miles") * 100, 1).alias("efficiency_pct"),
    )


def with_vehicle(mart, routes: DataFrame, *columns: str) -> DataFrame:
    """Routes with columns of their vehicle, null for one that is not known."""
    fleet = mart.vehicles.select("vehicle_no", *columns)
    return lookup_join(routes, fleet, "vehicle_no", "left", hot=mart.hot("routes", "vehicle_no"))


def route_load(mart) -> DataFrame:
    """Stops, and weight and volume of the orders on each route next to the capacity.

    An order with several stops on one route is loaded once.
    """
    # stops lie together by route, so they are counted by route and order where they are
    served = mart.stops.groupBy(*ROUTE_KEY, "order_no").agg(F.count(F.lit(1)).alias("stops"))
    packages = mart.orders.select("order_no", "package_weight_lbs", "package_volume_cuft")
    loads = (
        lookup_join(served, packages, "order_no", "left", hot=mart.hot("stops", "order_no"), salt_by=ROUTE_KEY)
        .groupBy(*ROUTE_KEY)
        .agg(
            F.sum("stops").alias("stops"),
            F.sum("package_weight_lbs").alias("weight"),
            F.sum("package_volume_cuft").alias("volume"),
        )
    )
    routes = mart.routes.select(*ROUTE_KEY, "route_id", "route_date", "vehicle_no", "vehicle_id", "depot_id", "planned_stops")
    routes = routes.join(loads, ROUTE_KEY, "left")
    limits = ["vehicle_type", "capacity_weight_lbs", "capacity_volume_cuft", "max_stops_per_route"]
    nothing = F.lit(0).cast("decimal(28,2)")
    return (
        with_vehicle(mart, routes, *limits)
        .withColumn("stops", F.coalesce("stops", F.lit(0)))
        .withColumn("load_weight_lbs", F.coalesce("weight", nothing))
        .withColumn("load_volume_cuft", F.coalesce("volume", nothing))
        .drop("weight", "volume")
    )


def load_utilization(mart) -> DataFrame:
    """Share of payload and of cargo space used by each route."""
    return route_load(mart).select(
        "route_id",
        "vehicle_id",
        "vehicle_type",
        "depot_id",
        "route_date",
        "load_weight_lbs",
        "load_volume_cuft",
        percent("load_weight_lbs", "capacity_weight_lbs").alias("weight_pct"),
        percent("load_volume_cuft", "capacity_volume_cuft").alias("volume_pct"),
    )


def utilization_heatmap(mart) -> DataFrame:
    """Load of each vehicle per day, in percent of its payload."""
    return (
        route_load(mart)
        .groupBy("vehicle_id", "route_date")
        .agg(
            F.count(F.lit(1)).alias("routes"),
            percent(F.sum("load_weight_lbs"), F.sum("capacity_weight_lbs")).alias("utilization_pct"),
        )
    )


def cost_per_mile_by_fuel(mart) -> DataFrame:
    """Vehicles and their average own rate per class and fuel."""
    return (
        mart.fleet.groupBy("vehicle_type", "fuel_type")
        .agg(F.count(F.lit(1)).alias("vehicles"), F.round(mean("cost_per_mile_usd"), 2).alias("avg_cost_per_mile"))
        .orderBy("vehicle_type", "fuel_type")
    )


def capacity_by_type(mart) -> DataFrame:
    """How often each class runs over capacity or under half of it.

    The fuller of weight and volume counts; a class is called over or under
    when at least half of its routes are.
    """
    used = F.greatest(
        ratio("load_weight_lbs", "capacity_weight_lbs"), ratio("load_volume_cuft", "capacity_volume_cuft")
    )
    shares = (
        route_load(mart)
        .groupBy("vehicle_type")
        .agg(
            F.count(F.lit(1)).alias("routes"),
            count_if(used > 1).alias("over_capacity"),
            count_if(used < 0.5).alias("under_half"),
        )
    )
    verdict = (
        F.when(F.col("over_capacity") * 2 >= F.col("routes"), "over")
        .when(F.col("under_half") * 2 >= F.col("routes"), "under")
        .otherwise("balanced")
    )
    return shares.select(
        "vehicle_type",
        "routes",
        percent("over_capacity", "routes").alias("over_pct"),
        percent("under_half", "routes").alias("under_pct"),
        verdict.alias("verdict"),
    ).orderBy("vehicle_type")


def route_paths(mart, piece: int = PATH_PIECE, **filters) -> DataFrame:
    """Ordered coordinates of each route with its vehicle class.

    Long routes come as several numbered pieces of at most ``piece`` positions,
    so no row or group grows with the route.
    """
    point = F.struct("stop_sequence", "lat", "lon")
    paths = (
        _points(mart).groupBy(*ROUTE_KEY, F.floor((F.col("stop_sequence") - 1) / piece).cast("int").alias("piece"))
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
    )
    routes = selected_routes(mart, **filters).select(*ROUTE_KEY, "route_id", "vehicle_no")
    routes = with_vehicle(mart, routes, "vehicle_type")
    paths = lookup_join(paths, routes, ROUTE_KEY, hot=mart.hot("stops", "route_no"), salt_by=["piece"])
    return paths.select("route_id", "vehicle_type", "piece", "points")


def path_text(points: str = "points"):
    """lat,lon;lat,lon;... with three decimals."""
    number = lambda c: c.cast("decimal(9,3)").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat(number(p.lat), F.lit(","), number(p.lon))), ";")


def affected_orders(mart, reason: str, **filters) -> DataFrame:
    """Orders hit by the given delay reason, with their delayed stops."""
    late = delayed(selected(mart.stops, mart, **filters)).where((F.col("delay_reason") == reason) & F.col("order_found"))
    per_order = late.groupBy("order_no").agg(
        F.count(F.lit(1)).alias("delayed_stops"), F.sum("delay_minutes").alias("delay_minutes")
    )
    orders = mart.orders.select("order_no", "order_id", "client_id", "depot_id", "service_region", "priority")
    return per_order.join(orders, "order_no").drop("order_no")


def late_rate_by_region(mart) -> DataFrame:
    regions = mart.state("stop_states").where("order_found").groupBy("service_region")
    totals = regions.agg(F.sum("stops").alias("stops"), F.sum("delayed").alias("late_stops"))
    return totals.withColumn("late_rate", percent("late_stops", "stops", 2)).orderBy("service_region")


def depot_share(mart) -> DataFrame:
    """Share of the orders per depot, largest first, and the running share.

    The windows see one row per depot, not the orders.
    """
    totals = mart.state("order_states").groupBy("depot_id").agg(F.sum("orders").alias("orders"))
    largest_first = Window.orderBy(F.col("orders").desc(), "depot_id").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    summed = totals.withColumns(
        {"running": F.sum("orders").over(largest_first), "total": F.sum("orders").over(everything)}
    )
    return summed.select(
        "depot_id",
        "orders",
        percent("orders", "total", 2).alias("share_pct"),
        percent("running", "total", 2).alias("running_share_pct"),
    )


def route_progress(mart) -> DataFrame:
    """Stops of each route by outcome against the planned number; unknown outcomes count as other."""
    known = F.coalesce(F.col("status").isin(*fv.STOP_STATUSES), F.lit(False))
    counts = mart.stops.groupBy(*ROUTE_KEY).agg(
        *[count_if(F.col("status") == s).alias(s) for s in fv.STOP_STATUSES], count_if(~known).alias("other")
    )
    outcomes = [F.coalesce(s, F.lit(0)).alias(s) for s in [*fv.STOP_STATUSES, "other"]]
    return mart.routes.join(counts, ROUTE_KEY, "left").select(
        "route_id",
        "planned_stops",
        *outcomes,
        percent(F.coalesce("completed", F.lit(0)), "planned_stops").alias("completed_pct"),
    )

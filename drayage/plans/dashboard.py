"""Dashboard reports: KPIs, routes, fleet, delays, map, choices, verification."""

from pyspark.sql import DataFrame, functions as F

from drayage.functions.metrics import count_if, mean, mean_ratio, percent, ratio, stop_color
from drayage.operators.joins import lookup_join
from drayage.operators.skew import bounded
from drayage.plans.filters import ROUTE_KEY, delayed, in_period, selected, selected_routes
from drayage.plans.states import distinct_vehicles


def active_vehicles(mart):
    """Number of active vehicles as a scalar subquery."""
    return mart.vehicles.where(F.col("status") == "active").agg(F.count(F.lit(1)).alias("n")).scalar()


def _headline(mart, totals: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return totals.select(
        F.coalesce(percent("on_time", "total"), zero).alias("on_time_rate"),
        F.round(F.coalesce("cost", zero), 2).alias("avg_cost_per_delivery"),
        F.round(F.coalesce("miles", zero), 2).alias("avg_miles_per_stop"),
        F.coalesce(percent("used", active_vehicles(mart)), zero).alias("fleet_utilization_pct"),
        F.col("total").alias("total_deliveries"),
        F.coalesce(percent("late", "total"), zero).alias("late_delivery_rate"),
    )


def kpis(mart, **filters) -> DataFrame:
    """One row of headline figures over the routes that meet the filters.

    Late means more than 15 minutes, on time exactly no delay, over all stops.
    Costs and miles are averages of per-route ratios.  Read from states, which know
    the date, depot and region of a stop; a client filter goes through the routes.
    """
    if filters.get("client"):
        return kpis_of_routes(mart, **filters)
    states = selected(mart.state("stop_states"), mart, **filters)
    routes = selected(mart.state("route_states"), mart, **filters)
    vehicles = selected(mart.state("vehicle_bitmaps"), mart, **filters)
    stops = states.agg(
        F.sum("on_time").alias("on_time"),
        F.sum("late").alias("late"),
        F.coalesce(F.sum("stops"), F.lit(0)).alias("total"),
    )
    ratios = routes.agg(
        ratio(F.sum("cost_ratios"), F.sum("costed")).alias("cost"), ratio(F.sum("mile_ratios"), F.sum("driven")).alias("miles")
    )
    # one row each, put side by side
    totals = stops.withColumns(
        {
            "cost": ratios.select("cost").scalar(),
            "miles": ratios.select("miles").scalar(),
            "used": distinct_vehicles(vehicles).scalar(),
        }
    )
    return _headline(mart, totals)


def kpis_of_routes(mart, **filters) -> DataFrame:
    """The headline figures from routes and stops themselves."""
    routes = selected_routes(mart, **filters).select(
        *ROUTE_KEY, "vehicle_id", "actual_cost_usd", "actual_miles", "planned_stops"
    )
    stops = in_period(mart.stops, "route_date", "route_month", filters.get("start"), filters.get("end"))
    stops = stops.groupBy(*ROUTE_KEY).agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("delay_minutes") == 0).alias("on_time"),
        count_if(F.col("delay_minutes") > 15).alias("late"),
    )
    totals = routes.join(stops, ROUTE_KEY, "left").agg(
        F.sum("on_time").alias("on_time"),
        F.sum("late").alias("late"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        mean_ratio("actual_cost_usd", "planned_stops").alias("cost"),
        mean_ratio("actual_miles", "planned_stops").alias("miles"),
        F.countDistinct("vehicle_id").alias("used"),
    )
    return _headline(mart, totals)


def routes(mart, date=None, depot=None, client=None, cap: int | None = None) -> DataFrame:
    """All routes, or the first cap of them, newest first; ties broken by depot and route."""
    found = selected_routes(mart, start=date, end=date, depot=depot, client=client)
    found = found.orderBy(F.col("route_date").desc(), "depot_id", "route_id")
    return found.limit(cap) if cap else found


def route_stops(mart, route: str) -> DataFrame:
    """The stops of one route in driving order; only the route's month is read."""
    month = mart.routes.where(F.col("route_id") == route).agg(F.max("route_month").alias("m")).scalar()
    return mart.stops.where((F.col("route_month") == month) & (F.col("route_id") == route)).orderBy("stop_sequence")


def vehicle_usage(mart, depot=None, vehicle_type=None, fleet: DataFrame | None = None) -> DataFrame:
    """Every vehicle, of ``fleet`` if given, with its number of routes and averages, 0 if unused."""
    used = mart.routes.groupBy("vehicle_no").agg(
        F.count(F.lit(1)).alias("route_count"),
        mean("actual_miles").alias("miles"),
        mean("actual_cost_usd").alias("cost"),
    )
    fleet = mart.vehicles if fleet is None else fleet
    if depot:
        fleet = fleet.where(F.col("depot_id") == depot)
    if vehicle_type:
        fleet = fleet.where(F.col("vehicle_type") == vehicle_type)
    return fleet.join(used, "vehicle_no", "left").select(
        *fleet.columns,
        F.coalesce("route_count", F.lit(0)).alias("route_count"),
        F.round(F.coalesce("miles", F.lit(0.0)), 1).alias("avg_miles_per_route"),
        F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("avg_cost_per_route"),
    )


def vehicles(mart, **filters) -> DataFrame:
    return vehicle_usage(mart, **filters).orderBy("depot_id", "vehicle_id")


def delay_facts(mart, start=None, end=None, region=None) -> DataFrame:
    """Delayed stops of known orders; what is asked of route and order stands on the stop."""
    stops = delayed(in_period(mart.stops, "route_date", "route_month", start, end))
    if region:
        stops = stops.where(F.col("service_region") == region)
    return stops.where("order_found").select(
        *ROUTE_KEY, F.col("route_date").alias("month"), "service_region", "delay_reason", "delay_minutes"
    )


def delay_states(mart, start=None, end=None, region=None) -> DataFrame:
    """Number and minutes of delayed stops of known orders by reason, month and region, from states."""
    states = in_period(mart.state("stop_states"), "route_date", "route_month", start, end)
    if region:
        states = states.where(F.col("service_region") == region)
    return states.where(F.col("order_found") & (F.col("delayed") > 0)).select(
        "delay_reason", F.col("route_date").alias("month"), "service_region", F.col("delayed").alias("stops"),
        F.col("delay_minutes").alias("minutes"),
    )


def _delay_totals(grouped) -> DataFrame:
    return grouped.agg(F.sum("stops").alias("count"), F.sum("minutes").alias("minutes"))


def _avg_delay():
    return F.round(ratio("minutes", "count"), 1).alias("avg_delay")


def delays_by_reason(mart, **filters) -> DataFrame:
    totals = _delay_totals(delay_states(mart, **filters).groupBy("delay_reason"))
    return totals.select(F.col("delay_reason").alias("label"), "count", _avg_delay()).orderBy(
        F.col("count").desc(), "label"
    )


def delays_by_month(mart, **filters) -> DataFrame:
    totals = _delay_totals(delay_states(mart, **filters).groupBy("delay_reason", "month"))
    return totals.select(F.col("delay_reason").alias("label"), "month", "count", _avg_delay()).orderBy(
        "month", F.col("count").desc(), "label"
    )


def delays_by_region(mart, **filters) -> DataFrame:
    totals = _delay_totals(delay_states(mart, **filters).groupBy("service_region"))
    return totals.select(F.col("service_region").alias("label"), "count", _avg_delay()).orderBy(
        F.col("count").desc(), "label"
    )


def delay_report(mart, **filters) -> DataFrame:
    """By reason, by reason and month, by region: grouping sets over states."""
    reason, month, region = F.col("delay_reason"), F.col("month"), F.col("service_region")
    totals = (
        delay_states(mart, **filters)
        .groupingSets([[reason], [reason, month], [region]], reason, month, region)
        .agg(
            F.sum("stops").alias("count"),
            F.sum("minutes").alias("minutes"),
            F.grouping("month").alias("no_month"),
            F.grouping("service_region").alias("no_region"),
        )
    )
    category = (
        F.when(F.col("no_region") == 0, "by_region").when(F.col("no_month") == 0, "by_month").otherwise("by_reason")
    )
    label = F.when(F.col("no_region") == 0, region).otherwise(reason)
    return totals.select(
        category.alias("category"), label.alias("label"), "month", "count", _avg_delay()
    ).orderBy("category", "month", F.col("count").desc(), "label")


def worst_routes(mart, n: int = 10, **filters) -> DataFrame:
    """Routes with the most delay minutes; ties broken by route."""
    late = delayed(in_period(mart.stops, "route_date", "route_month", filters.get("start"), filters.get("end")))
    late = late.groupBy(*ROUTE_KEY).agg(
        F.sum("delay_minutes").alias("total_delay_minutes"), F.count(F.lit(1)).alias("delayed_stops")
    )
    found = selected_routes(mart, **filters).select(*ROUTE_KEY, "route_id", "depot_id", "route_date", "vehicle_id")
    return (
        late.join(found, ROUTE_KEY)
        .select("route_id", "depot_id", "route_date", "vehicle_id", "total_delay_minutes", "delayed_stops")
        .orderBy(F.col("total_delay_minutes").desc(), "route_id")
        .limit(n)
    )


def _near(df: DataFrame, box) -> DataFrame:
    """Rows inside a box (south, west, north, east); its edges belong to it."""
    if box:
        south, west, north, east = box
        df = df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return df


def located_stops(mart, box=None, **filters) -> DataFrame:
    """Stops with the place of their order, unknown places included.

    A box has no use for stops without a place, so it reads those that have one, stored
    in order of place.
    """
    if box:
        return _near(selected(mart.state("stop_places"), mart, **filters), box)
    stops = selected(mart.stops, mart, **filters).where("order_found")
    return stops.withColumnsRenamed({"destination_lat": "lat", "destination_lon": "lon"})


def first_located_stops(mart, cap: int, **filters) -> DataFrame:
    """The first stops by route and sequence that have an order."""
    return located_stops(mart, **filters).orderBy("route_id", "stop_sequence").limit(cap)


def map_stops(mart, date=None, depot=None, cap: int | None = None, box=None) -> DataFrame:
    """Stops to draw on the map, with the colour of their delay."""
    filters = {"start": date, "end": date, "depot": depot, "box": box}
    found = first_located_stops(mart, cap, **filters) if cap else located_stops(mart, **filters)
    found = found.select(
        "route_id",
        "depot_id",
        "vehicle_id",
        "stop_sequence",
        "order_no",
        "order_id",
        "lat",
        "lon",
        F.coalesce("delay_minutes", F.lit(0)).alias("delay_minutes"),
        "status",
        stop_color(F.col("delay_minutes")).alias("color"),
    )
    places = mart.orders.select("order_no", F.col("destination_address").alias("address"))
    found = bounded(found, cap) if cap else found
    found = lookup_join(found, places, "order_no", "left", hot=None if cap else mart.hot("stops", "order_no"))
    return found.drop("order_no").orderBy("route_id", "stop_sequence")


def depot_list(mart) -> DataFrame:
    return mart.depots.select("depot_id", "lat", "lon", "name").orderBy("depot_id")


def client_list(mart) -> DataFrame:
    return mart.clients.select("client_id").orderBy("client_id")


def region_list(mart) -> DataFrame:
    return mart.orders.select("service_region").distinct().orderBy("service_region")


def verification(mart) -> DataFrame:
    """Row counts, distinct categories and late share, one row per check."""

    def rows(df, *aggregates):
        names = [name for name, _ in aggregates]
        pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
        return df.agg(*[a.alias(n) for n, a in aggregates]).selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")

    everything = F.count(F.lit(1))
    parts = [
        rows(mart.vehicles, ("vehicles", everything), ("vehicle_types", F.countDistinct("vehicle_type"))),
        rows(
            mart.orders,
            ("delivery_orders", everything),
            ("depots", F.countDistinct("depot_id")),
            ("clients", F.countDistinct("client_id")),
            ("regions", F.countDistinct("service_region")),
        ),
        rows(
            mart.routes,
            ("route_plans", everything),
            ("optimization_methods", F.countDistinct("optimization_method")),
        ),
        rows(
            mart.stops,
            ("route_stops", everything),
            ("late_pct", percent(count_if(F.col("delay_minutes") > 0), everything)),
        ),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report

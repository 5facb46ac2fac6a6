"""Declared schemas of the mart tables, with a comment on every column.

Money, miles and durations are DECIMAL so that sums do not depend on the order
in which tasks finish: a rerun after a lost executor gives the same digits.
``route_month`` / ``requested_month`` (yyyy-MM) are the storage partitions.
"""

from pyspark.sql import types as T

STRING, INT, LONG, DATE, NTZ, DOUBLE = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DateType(),
    T.TimestampNTZType(),
    T.DoubleType(),
)
USD = T.DecimalType(18, 2)
TENTHS = T.DecimalType(18, 1)
MEASURE = T.DecimalType(18, 2)


def _table(*columns):
    return T.StructType([T.StructField(n, t, True, {"comment": c}) for n, t, c in columns])


DEPOTS = _table(
    ("depot_id", STRING, "Depot key, DEPOT_ plus the depot name"),
    ("name", STRING, "Depot name"),
    ("lat", DOUBLE, "Depot latitude in degrees"),
    ("lon", DOUBLE, "Depot longitude in degrees"),
    ("service_region", STRING, "Region served by the depot"),
    ("depot_class", STRING, "Demand class: busy, regular or small"),
)

CLIENTS = _table(
    ("client_id", STRING, "Client program key"),
)

VEHICLES = _table(
    ("vehicle_no", LONG, "Fleet number"),
    ("vehicle_id", STRING, "Vehicle key, VH- plus the fleet number"),
    ("vehicle_type", STRING, "One of the six vehicle classes"),
    ("capacity_weight_lbs", INT, "Payload limit in pounds"),
    ("capacity_volume_cuft", INT, "Cargo space in cubic feet"),
    ("max_stops_per_route", INT, "Most stops one route of this vehicle may have"),
    ("depot_id", STRING, "Home depot, see depots.depot_id"),
    ("fuel_type", STRING, "diesel, gasoline, electric or hybrid"),
    ("cost_per_mile_usd", USD, "Running cost per mile"),
    ("daily_fixed_cost_usd", USD, "Cost per day regardless of mileage"),
    ("status", STRING, "active, maintenance or retired"),
)

DELIVERY_ORDERS = _table(
    ("order_no", LONG, "Order number; joins with route_stops.order_no"),
    ("order_id", STRING, "Order key, ORD- plus the order number"),
    ("client_id", STRING, "Client program that placed the order"),
    ("depot_id", STRING, "Depot the order ships from, see depots.depot_id"),
    ("destination_address", STRING, "Customer and nation of the drop; no source has a street"),
    ("destination_lat", DOUBLE, "Latitude of the drop, that of its nation"),
    ("destination_lon", DOUBLE, "Longitude of the drop, that of its nation"),
    ("requested_date", DATE, "Day the delivery was asked for"),
    ("window_start_min", INT, "Delivery window start, minutes after midnight"),
    ("window_end_min", INT, "Delivery window end, minutes after midnight"),
    ("time_window_start", STRING, "Delivery window start as HH:MM:SS"),
    ("time_window_end", STRING, "Delivery window end as HH:MM:SS"),
    ("package_weight_lbs", MEASURE, "Weight of the order in pounds"),
    ("package_volume_cuft", MEASURE, "Volume of the order in cubic feet"),
    ("service_region", STRING, "Region of the drop"),
    ("priority", STRING, "standard, priority or express"),
    ("status", STRING, "delivered, in_transit, pending, cancelled or returned"),
    ("requested_month", STRING, "Month of requested_date as yyyy-MM; storage partition"),
)

ROUTE_PLANS = _table(
    ("route_no", LONG, "Route number: month, then vehicle; joins with route_stops.route_no"),
    ("route_id", STRING, "Route key, RT- plus vehicle number and period"),
    ("route_date", DATE, "First day of the period the route covers"),
    ("vehicle_no", LONG, "Fleet number of the vehicle"),
    ("vehicle_id", STRING, "Vehicle driving the route, see vehicles.vehicle_id"),
    ("driver_id", STRING, "Driver of the route; each vehicle has its own"),
    ("depot_id", STRING, "Depot the route starts from"),
    ("client_mix", T.ArrayType(STRING), "Client programs served, in alphabetical order"),
    ("planned_stops", LONG, "Number of planned stops"),
    ("planned_miles", TENTHS, "Planned distance: one round trip to each place served"),
    ("planned_duration_min", TENTHS, "Planned duration in minutes"),
    ("planned_cost_usd", USD, "Planned cost: day rate, mileage and stops"),
    ("actual_miles", TENTHS, "Driven distance: a round trip to a place for each day it was served"),
    ("actual_duration_min", TENTHS, "Real duration in minutes"),
    ("actual_cost_usd", USD, "Real cost: a share of the charges of the lines delivered"),
    ("optimization_method", STRING, "How the route was laid out (a label)"),
    ("route_month", STRING, "Month of route_date as yyyy-MM; storage partition"),
)

ROUTE_STOPS = _table(
    ("route_stop_id", STRING, "Stop key, RS- plus route and position"),
    ("route_no", LONG, "Number of the route, see route_plans.route_no"),
    ("route_id", STRING, "Route of the stop, see route_plans.route_id"),
    ("stop_sequence", LONG, "Position within the route, from 1"),
    ("order_no", LONG, "Number of the order served; may be missing"),
    ("order_id", STRING, "Order served, see delivery_orders.order_id; may be missing"),
    ("order_found", T.BooleanType(), "The order is in delivery_orders"),
    ("route_date", DATE, "First day of the route's period"),
    ("vehicle_id", STRING, "Vehicle of the route"),
    ("depot_id", STRING, "Depot of the route"),
    ("client_id", STRING, "Client program of the order"),
    ("service_region", STRING, "Region of the order"),
    ("destination_lat", DOUBLE, "Latitude of the order's drop"),
    ("destination_lon", DOUBLE, "Longitude of the order's drop"),
    ("planned_arrival", NTZ, "Planned arrival"),
    ("actual_arrival", NTZ, "Real arrival"),
    ("planned_departure", NTZ, "Planned departure"),
    ("actual_departure", NTZ, "Real departure"),
    ("status", STRING, "completed, attempted, rescheduled or skipped"),
    ("delay_minutes", INT, "Minutes late, 0 when on time"),
    ("delay_reason", STRING, "Cause of the delay, missing when on time"),
    ("service_time_min", INT, "Minutes spent at the stop"),
    ("route_month", STRING, "Month of the route as yyyy-MM; storage partition"),
)

TABLES = {
    "vehicles": VEHICLES,
    "delivery_orders": DELIVERY_ORDERS,
    "route_plans": ROUTE_PLANS,
    "route_stops": ROUTE_STOPS,
}

#: Columns that files are bucketed by, so that joins and groupings by them move no rows.
BUCKET_COLUMNS = {
    "vehicles": None,
    "delivery_orders": "order_no",
    "served_lines": "route_no",
    "route_plans": "route_no",
    "route_stops": "route_no",
}

PARTITION_COLUMNS = {
    "vehicles": None,
    "delivery_orders": "requested_month",
    "served_lines": None,
    "stop_states": None,
    "route_states": None,
    "vehicle_bitmaps": None,
    "order_states": None,
    "stop_places": "route_month",
    "route_plans": "route_month",
    "route_stops": "route_month",
}


def conform(df, schema):
    """Select the declared columns in order, with declared types and comments."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])

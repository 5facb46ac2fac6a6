"""Summed-up states of the mart that reports read instead of its long tables.

A state is additive: counts, whole minutes and exact decimal sums, or bitmaps that are
merged by OR.  Rows carry the month they come from, so a month that changes is replaced
and all others stay.  Every report that reads states equals the one over the tables.
"""

from pyspark.sql import Column, DataFrame, functions as F

from drayage.functions.calendar import week_of
from drayage.functions.metrics import count_if, ratio

#: Digits of a ratio that is summed.
EXACT = "decimal(38,12)"
#: Bits of each coordinate in a place's key.
PLACE_BITS = 16


def _sum_of(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast(EXACT)), F.lit(0).cast(EXACT))


def stop_states(mart) -> DataFrame:
    """Stops by route month, week of arrival, depot, region of the order and delay reason."""
    delay, done = F.col("delay_minutes"), F.coalesce(F.col("status") == "completed", F.lit(False))
    return mart.stops.groupBy(
        "route_month",
        "route_date",
        week_of(F.col("planned_arrival")).alias("week"),
        "depot_id",
        "service_region",
        "order_found",
        "delay_reason",
    ).agg(
        F.count(F.lit(1)).alias("stops"),
        count_if(delay == 0).alias("on_time"),
        count_if(delay > 0).alias("delayed"),
        count_if(delay > 15).alias("late"),
        F.coalesce(F.sum(F.when(delay > 0, delay)), F.lit(0)).alias("delay_minutes"),
        count_if(done).alias("completed"),
        count_if(done & (delay == 0)).alias("completed_on_time"),
        count_if(done & (delay > 0)).alias("completed_delayed"),
    )


def efficiency() -> Column:
    """Planned over actual miles in percent: 100 at most, and 90 when either is missing or 0."""
    planned, actual = F.col("planned_miles").cast("double"), F.col("actual_miles").cast("double")
    known = (F.coalesce(planned, F.lit(0.0)) != 0) & (F.coalesce(actual, F.lit(0.0)) != 0)
    return F.when(known, F.least(F.lit(100.0), planned / F.when(known, actual) * 100.0)).otherwise(90.0)


def route_states(mart) -> DataFrame:
    """Routes by date and depot: numbers, and exact sums of the routes' ratios."""
    cost, miles = ratio("actual_cost_usd", "planned_stops"), ratio("actual_miles", "planned_stops")
    return mart.routes.groupBy("route_month", "route_date", "depot_id").agg(
        F.count(F.lit(1)).alias("routes"),
        F.coalesce(F.sum("planned_stops"), F.lit(0)).alias("planned_stops"),
        _sum_of(cost).alias("cost_ratios"),
        F.count(cost).alias("costed"),
        _sum_of(miles).alias("mile_ratios"),
        F.count(miles).alias("driven"),
        _sum_of(efficiency()).alias("efficiencies"),
    )


def vehicle_bitmaps(mart) -> DataFrame:
    """Vehicles with a route by date and depot: one bit each, 32,768 to a row."""
    number = F.col("vehicle_no")
    return (
        mart.routes.where(number.isNotNull())
        .groupBy("route_month", "route_date", "depot_id", F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("vehicles"))
    )


def distinct_vehicles(bitmaps: DataFrame) -> DataFrame:
    """One row: how many different vehicles the bitmaps hold together."""
    merged = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("vehicles").alias("vehicles"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("vehicles")), F.lit(0)).alias("used"))


def order_states(mart) -> DataFrame:
    """Orders by requested month, depot, region and client."""
    return mart.orders.groupBy("requested_month", "depot_id", "service_region", "client_id").agg(
        F.count(F.lit(1)).alias("orders")
    )


def cell(degrees: Column, low: float, span: float) -> Column:
    """Number of the strip of the given span that holds a coordinate."""
    at = F.floor((degrees - F.lit(low)) / F.lit(span) * F.lit(1 << PLACE_BITS))
    return F.greatest(F.lit(0), F.least(F.lit((1 << PLACE_BITS) - 1), at)).cast("long")


def spread(bits: Column) -> Column:
    """The bits of a number under 2 ** 16 at every second position."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return bits


def place_key(lat: Column, lon: Column) -> Column:
    """Morton key: places near each other have mostly near keys."""
    return F.shiftleft(spread(cell(lat, -90.0, 180.0)), 1).bitwiseOR(spread(cell(lon, -180.0, 360.0)))


def stop_places(mart) -> DataFrame:
    """Stops whose order is known and has a place, range-sorted by the place's key.

    Where months are replaced later on, each month is sorted by itself.

    A file holds a small area, so a box reads the files and row groups whose coordinates
    meet it.  Equal keys are ordered by route, so one place spreads over as many files as
    it needs.
    """
    lat, lon = F.col("destination_lat"), F.col("destination_lon")
    placed = mart.stops.where(F.col("order_found") & lat.isNotNull() & lon.isNotNull()).select(
        place_key(lat, lon).alias("place"),
        lat.alias("lat"),
        lon.alias("lon"),
        "route_date",
        "route_no",
        "route_id",
        "stop_sequence",
        "order_no",
        "order_id",
        "depot_id",
        "vehicle_id",
        "delay_minutes",
        "status",
        "route_month",
    )
    order = ["place", "route_no", "stop_sequence"]
    if mart.renewed:
        order = ["route_month", *order]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


STATES = {
    "stop_states": stop_states,
    "route_states": route_states,
    "vehicle_bitmaps": vehicle_bitmaps,
    "order_states": order_states,
    "stop_places": stop_places,
}
#: The month that a state's rows belong to, and the table they come from.
MONTHS = {
    "stop_states": ("route_month", "route_stops"),
    "route_states": ("route_month", "route_plans"),
    "vehicle_bitmaps": ("route_month", "route_plans"),
    "order_states": ("requested_month", "delivery_orders"),
    "stop_places": ("route_month", "route_stops"),
}

"""Planning arithmetic for routes and stops, in exact decimals."""

from pyspark.sql import Column, functions as F

from drayage import fixed_values as fv
from drayage.functions.draws import format_id
from drayage.functions.metrics import haversine_miles


def plan_cost(daily_fixed: Column, miles: Column, per_mile: Column, stops: Column) -> Column:
    return F.round(daily_fixed + miles * per_mile + stops * F.lit(fv.STOP_COST_USD), 2)


def plan_duration(stops: Column, minutes_per_stop, miles: Column) -> Column:
    return F.round(stops * minutes_per_stop + miles * F.lit(fv.MINUTES_PER_MILE), 1)


def lookup(keys: tuple[Column, ...], values: dict) -> Column:
    """The value listed for the keys; null for any others."""
    chosen = F.lit(None)
    for key, value in values.items():
        key = key if isinstance(key, tuple) else (key,)
        hit = F.lit(True)
        for column, wanted in zip(keys, key):
            hit = hit & (column == F.lit(wanted))
        chosen = F.when(hit, F.lit(value)).otherwise(chosen)
    return chosen


def freight(price: Column, discount: Column, tax: Column) -> Column:
    """What the delivery of a line costs: a share of price, less discount, plus tax."""
    exact = [c.cast("decimal(14,2)") for c in (price, discount, tax)]
    charge = (exact[0] * (F.lit(1) - exact[1])).cast("decimal(20,4)") * (F.lit(1) + exact[2])
    return (charge.cast("decimal(22,6)") * F.lit(fv.FREIGHT_SHARE)).cast("decimal(24,8)")


def service_minutes(quantity: Column) -> Column:
    return (F.lit(fv.SERVICE_MINUTES) + F.floor(quantity / fv.UNITS_PER_MINUTE)).cast("int")


def delay_minutes(requested: Column, shipped: Column) -> Column:
    """Minutes late: days past the requested one, on the scale of a delivery day; 0 if unknown or in time."""
    overdue = F.greatest(F.datediff(shipped, requested), F.lit(0))
    return F.coalesce(F.floor(overdue / fv.DAYS_PER_DELAY_MINUTE).cast("int"), F.lit(0))


def round_trip(lat1, lon1, lat2, lon2) -> Column:
    """Miles there and back in a straight line, in tenths."""
    return (haversine_miles(lat1, lon1, lat2, lon2) * 2).cast("decimal(18,1)")


def layout_method(stops: Column) -> Column:
    """How a route of so many stops is laid out."""
    by_hand, nearest = stops <= fv.MANUAL_STOPS, stops <= fv.GREEDY_STOPS
    return F.when(by_hand, "manual_dispatch").when(nearest, "greedy_nearest").otherwise("or_tools_cvrp")


def stop_target(max_stops: Column, observed: Column) -> Column:
    """Stops to plan for a vehicle: what it has had on average, rounded up, within its limit."""
    return F.least(max_stops, F.coalesce(F.ceil(observed), F.lit(0)).cast("int"))


def driver_id(vehicle_no: Column) -> Column:
    """The driver of a vehicle, the same every day."""
    return format_id("DRV-", vehicle_no, 3)


def minutes_into_route(sequence: Column, duration: Column, stops: Column) -> Column:
    """Whole minutes from the start of the working day to the given stop.

    The pace is kept in thousandths of a minute.  A long route runs on into the
    next day, so later stops never arrive earlier.
    """
    thousandths = (duration * 1000).cast("long")
    pace = F.call_function("div", thousandths, F.greatest(stops, F.lit(1)))
    return F.call_function("div", sequence.cast("long") * pace, F.lit(1000)).cast("int")


def after(ts: Column, minutes: Column) -> Column:
    """Timestamp plus minutes; carries into the next hour and day."""
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, minutes)


def stop_timeline(day: Column, offset: Column, delay: Column, service: Column):
    """Planned and actual arrival and departure; the working day starts at 07:00."""
    start, planned = day.cast("timestamp_ntz"), offset + 7 * 60
    actual = planned + delay
    return {
        "planned_arrival": after(start, planned),
        "actual_arrival": after(start, actual),
        "planned_departure": after(start, planned + service),
        "actual_departure": after(start, actual + service),
    }

"""Dates and times of day."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

from drayage import fixed_values as fv


def _lookup(value: Column, factors: dict) -> Column:
    chosen = None
    for key, factor in factors.items():
        hit = value == F.lit(key)
        chosen = F.when(hit, F.lit(factor)) if chosen is None else chosen.when(hit, F.lit(factor))
    return chosen.otherwise(F.lit(Decimal("1.0")))


def calendar_weight(date: Column, depot_class: Column | None = None) -> Column:
    """Month factor times weekday factor, times the depot-class factor if given."""
    weight = _lookup(F.month(date), fv.MONTH_FACTORS) * _lookup(F.dayofweek(date), fv.WEEKDAY_FACTORS)
    if depot_class is not None:
        weight = weight * _lookup(depot_class, fv.DEPOT_CLASS_FACTORS)
    return weight


def time_of_day(minutes: Column) -> Column:
    """Minutes after midnight as HH:MM:SS."""
    hours = F.lpad(F.floor(minutes / 60).cast("string"), 2, "0")
    rest = F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.concat(hours, F.lit(":"), rest, F.lit(":00"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def month_of(date: Column) -> Column:
    """Storage month, yyyy-MM."""
    return F.date_format(date, "yyyy-MM")


def week_of(date: Column) -> Column:
    """Monday of the week."""
    return F.trunc(date.cast("date"), "week")

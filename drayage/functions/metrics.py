"""Metric expressions shared by the reports."""

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(condition: Column) -> Column:
    """Number of rows that meet the condition, 0 on no rows."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def percent(part, whole, digits: int = 1) -> Column:
    """part of whole in percent; NULL when there is nothing to divide by."""
    whole = F.nullif(col(whole).cast("double"), F.lit(0.0))
    return F.round(col(part).cast("double") * 100.0 / whole, digits)


def ratio(top, bottom) -> Column:
    """top / bottom as a double; NULL on a zero or missing bottom."""
    return col(top).cast("double") / F.nullif(col(bottom).cast("double"), F.lit(0.0))


def mean(c) -> Column:
    """Average of an exact column: decimal or integer sum, then one division."""
    c = col(c)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)).cast("double")


def mean_ratio(top, bottom) -> Column:
    """Average of the rows' ratios; decimals, so the sum does not depend on the order of rows."""
    each = ratio(top, bottom).cast("decimal(38,12)")
    return F.sum(each).cast("double") / F.nullif(F.count(each), F.lit(0)).cast("double")


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 3958.8 miles radius."""
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * 3958.8)


def stop_color(delay: Column) -> Column:
    """Map colour of a stop: on time, up to 15 minutes late, later."""
    delay = F.coalesce(delay, F.lit(0))
    return F.when(delay == 0, "green").when(delay <= 15, "gold").otherwise("red")

"""Optional report filters; an absent value adds no predicate."""

from pyspark.sql import DataFrame, functions as F

ROUTE_KEY = ["route_no"]


def in_period(df: DataFrame, date: str, month: str, start: str | None, end: str | None) -> DataFrame:
    """Dates within [start, end], plus the month range that prunes partitions."""
    if start:
        df = df.where((F.col(date) >= F.to_date(F.lit(start))) & (F.col(month) >= start[:7]))
    if end:
        df = df.where((F.col(date) <= F.to_date(F.lit(end))) & (F.col(month) <= end[:7]))
    return df


def selected(df: DataFrame, mart, start=None, end=None, depot=None, client=None, region=None) -> DataFrame:
    """Routes, their stops or their states that meet the filters.

    ``client`` matches a whole entry of the mix, so it takes routes.  ``region`` keeps
    what belongs to a depot with an order of that region in the route's month: a
    semi-join that Spark runs with the rest, against a row for each depot and month.
    """
    df = in_period(df, "route_date", "route_month", start, end)
    if depot:
        df = df.where(F.col("depot_id") == depot)
    if client:
        df = df.where(F.array_contains("client_mix", client))
    if region:
        served = mart.state("order_states").where(F.col("service_region") == region)
        served = served.select("depot_id", F.col("requested_month").alias("route_month")).distinct()
        df = df.join(served, ["depot_id", "route_month"], "left_semi")
    return df


def selected_routes(mart, **filters) -> DataFrame:
    return selected(mart.routes, mart, **filters)


def delayed(stops: DataFrame) -> DataFrame:
    return stops.where(F.col("delay_minutes") > 0)

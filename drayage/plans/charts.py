"""Figures behind the dashboard charts, over every matching row."""

from pyspark.sql import DataFrame, functions as F

from drayage import fixed_values as fv
from drayage.functions.calendar import week_of
from drayage.functions.metrics import mean, ratio
from drayage.plans import dashboard
from drayage.plans.filters import selected, selected_routes
from drayage.plans.states import EXACT, efficiency


def depot_label(column: str = "depot_id"):
    return F.regexp_replace(column, "^DEPOT_", "")


def cost_by_depot(mart, **filters) -> DataFrame:
    """Total cost over total stops per depot; 0 for a depot without stops."""
    totals = selected_routes(mart, **filters).groupBy("depot_id").agg(
        F.coalesce(F.sum("actual_cost_usd"), F.lit(0)).alias("cost"),
        F.coalesce(F.sum("planned_stops"), F.lit(0)).alias("stops"),
    )
    return totals.select(
        depot_label().alias("depot"),
        F.round(F.coalesce(ratio("cost", "stops"), F.lit(0.0)), 2).alias("cost_per_delivery"),
    ).orderBy("depot")


def efficiency_trend(mart, period: str = "day", last: int | None = None, **filters) -> DataFrame:
    """Average planned/actual miles in percent for all periods, or the newest ones.

    A route counts 100 at most, and 90 when either distance is missing or 0.
    """
    day = F.col("route_date")
    bucket = {"day": day, "week": week_of(day), "month": F.trunc(day, "month")}[period]
    if filters.get("client"):
        routes = selected(mart.routes, mart, **filters).withColumns({"routes": F.lit(1), "efficiencies": efficiency().cast(EXACT)})
    else:
        routes = selected(mart.state("route_states"), mart, **filters)
    trend = (
        routes.where(day.isNotNull())
        .groupBy(bucket.alias("period"))
        .agg(
            F.coalesce(F.sum("planned_stops"), F.lit(0)).alias("planned_stops"),
            ratio(F.sum("efficiencies"), F.sum("routes")).alias("rate"),
        )
    )
    trend = trend.select("period", "planned_stops", F.round("rate", 1).alias("rate"))
    if last:
        trend = trend.orderBy(F.col("period").desc()).limit(last)
    return trend.orderBy("period")


def vehicles_by_status(mart) -> DataFrame:
    return mart.vehicles.groupBy("status").agg(F.count(F.lit(1)).alias("vehicles")).orderBy("status")


def cost_by_type(mart, **filters) -> DataFrame:
    return (
        dashboard.vehicle_usage(mart, **filters)
        .groupBy("vehicle_type")
        .agg(
            F.round(mean("cost_per_mile_usd"), 2).alias("avg_cost_per_mile"),
            F.sum("route_count").alias("total_routes"),
        )
        .orderBy("vehicle_type")
    )


def vehicle_types(mart) -> DataFrame:
    return mart.vehicles.select("vehicle_type").distinct().orderBy("vehicle_type")


def delay_pivot(mart, **filters) -> DataFrame:
    """Delayed stops per month, one column per known reason and one for all others."""
    states = dashboard.delay_states(mart, **filters)
    reason = F.col("delay_reason")
    known = F.coalesce(reason.isin(*fv.DELAY_REASONS), F.lit(False))

    def stops_if(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("stops"))), F.lit(0))

    return (
        states.groupBy(F.date_format("month", "yyyy-MM").alias("month"))
        .agg(*[stops_if(reason == r).alias(r) for r in fv.DELAY_REASONS], stops_if(~known).alias("other"))
        .orderBy("month")
    )


def region_bars(mart, **filters) -> DataFrame:
    return dashboard.delays_by_region(mart, **filters).withColumnsRenamed({"label": "region", "count": "delayed_stops"})


def reason_bars(mart, **filters) -> DataFrame:
    return dashboard.delays_by_reason(mart, **filters).withColumnsRenamed({"label": "reason", "count": "delayed_stops"})


def map_depots(mart, depot=None, **filters) -> DataFrame:
    """Depots with the number of stops drawn for them, 0 if none; the chosen one alone if one is chosen."""
    counts = dashboard.located_stops(mart, depot=depot, **filters).groupBy("depot_id").agg(F.count(F.lit(1)).alias("stops"))
    depots = mart.depots.where(F.col("depot_id") == depot) if depot else mart.depots
    return depots.join(counts, "depot_id", "left").select(
        "depot_id", "name", "lat", "lon", F.coalesce("stops", F.lit(0)).alias("stops")
    ).orderBy("depot_id")


def map_bounds(mart, **filters) -> DataFrame:
    """Smallest box around all depots and all stops that have coordinates."""
    points = dashboard.located_stops(mart, **filters).select("lat", "lon")
    points = points.unionByName(mart.depots.select("lat", "lon")).where("lat is not null and lon is not null")
    return points.agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def severe_routes(mart, n: int = 10, minutes: int = 60, **filters) -> DataFrame:
    """Worst routes, flagged when their total delay exceeds the threshold."""
    return dashboard.worst_routes(mart, n, **filters).withColumn(
        "severe", F.col("total_delay_minutes") > minutes
    )

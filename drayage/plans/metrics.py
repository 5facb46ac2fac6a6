"""The six defined metrics and the example queries."""

from pyspark.sql import DataFrame, functions as F

from drayage.functions.metrics import mean, mean_ratio, percent, ratio
from drayage.plans import dashboard
from drayage.plans.filters import selected
from drayage.plans.states import distinct_vehicles


def completed(mart) -> DataFrame:
    return mart.stops.where(F.col("status") == "completed")


def on_time_rate(mart) -> DataFrame:
    """Completed stops without any delay, in percent."""
    states = mart.state("stop_states")
    return states.agg(percent(F.sum("completed_on_time"), F.sum("completed")).alias("on_time_rate"))


def late_rate(mart) -> DataFrame:
    """Completed stops with any delay, in percent."""
    states = mart.state("stop_states")
    return states.agg(percent(F.sum("completed_delayed"), F.sum("completed")).alias("late_delivery_rate"))


def cost_per_delivery(mart) -> DataFrame:
    return mart.routes.agg(F.round(mean_ratio("actual_cost_usd", "planned_stops"), 2).alias("cost_per_delivery"))


def miles_per_stop(mart) -> DataFrame:
    return mart.routes.agg(F.round(mean_ratio("actual_miles", "planned_stops"), 2).alias("miles_per_stop"))


def fleet_utilization(mart, start=None, end=None) -> DataFrame:
    """Vehicles with a route in the period, as percent of the active fleet."""
    used = distinct_vehicles(selected(mart.state("vehicle_bitmaps"), mart, start=start, end=end))
    return used.select(percent("used", dashboard.active_vehicles(mart)).alias("fleet_utilization_pct"))


def route_efficiency(mart) -> DataFrame:
    """Average planned/actual miles in percent over routes that were driven."""
    driven = mart.routes.where(F.col("actual_miles") > 0)
    return driven.agg(F.round(mean_ratio("planned_miles", "actual_miles") * 100, 1).alias("route_efficiency_pct"))


def cost_by_depot(mart) -> DataFrame:
    return (
        mart.routes.groupBy("depot_id")
        .agg(F.round(mean_ratio("actual_cost_usd", "planned_stops"), 2).alias("avg_cost_per_delivery"))
        .orderBy(F.col("avg_cost_per_delivery").desc(), "depot_id")
    )


def on_time_by_week(mart) -> DataFrame:
    weeks = mart.state("stop_states").groupBy("week").agg(
        F.sum("completed").alias("completed"), F.sum("completed_on_time").alias("on_time")
    )
    return weeks.where("completed > 0").select("week", percent("on_time", "completed").alias("on_time_rate")).orderBy("week")


def delay_reasons_by_region(mart) -> DataFrame:
    """Stops of known orders with a delay reason, per region of their order."""
    states = mart.state("stop_states").where(F.col("order_found") & F.col("delay_reason").isNotNull())
    return (
        states.groupBy("service_region", "delay_reason")
        .agg(F.sum("stops").alias("cnt"))
        .orderBy(F.col("cnt").desc(), "service_region", "delay_reason")
    )


def routes_by_type(mart) -> DataFrame:
    """Routes, each of which has one row, and average miles per vehicle class; unknown vehicles have none."""
    per_vehicle = mart.routes.groupBy("vehicle_no").agg(
        F.count(F.lit(1)).alias("routes"),
        F.sum("actual_miles").alias("miles"),
        F.count("actual_miles").alias("driven"),
    )
    return (
        per_vehicle.join(mart.vehicles.select("vehicle_no", "vehicle_type"), "vehicle_no", "left")
        .groupBy("vehicle_type")
        .agg(
            F.sum("routes").alias("routes"),
            F.round(ratio(F.sum("miles"), F.sum("driven")), 1).alias("avg_miles"),
        )
        .orderBy("vehicle_type")
    )


def plan_vs_actual(mart) -> DataFrame:
    return (
        mart.routes.groupBy("optimization_method")
        .agg(
            F.round(mean("planned_miles"), 1).alias("avg_planned"),
            F.round(mean("actual_miles"), 1).alias("avg_actual"),
            F.round(mean_ratio("actual_cost_usd", "planned_stops"), 2).alias("cost_per_stop"),
        )
        .orderBy("cost_per_stop", "optimization_method")
    )


def cost_and_miles_by_depot(mart) -> DataFrame:
    return (
        mart.routes.groupBy("depot_id")
        .agg(
            F.round(mean_ratio("actual_cost_usd", "planned_stops"), 2).alias("avg_cost_per_delivery"),
            F.round(mean_ratio("actual_miles", "planned_stops"), 2).alias("avg_miles_per_stop"),
        )
        .orderBy(F.col("avg_cost_per_delivery").desc(), "depot_id")
    )

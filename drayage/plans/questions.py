"""Answers to the sample business questions."""

from pyspark.sql import DataFrame, Window, functions as F

from drayage.functions.calendar import month_of
from drayage.functions.metrics import count_if, mean_ratio, percent, ratio
from drayage.plans import metrics, planning


def newest_route_date(mart):
    return mart.routes.agg(F.max("route_date").alias("newest")).scalar()


def costliest_routes_last_month(mart, n: int = 10) -> DataFrame:
    """Highest cost per delivery in the month before the newest route."""
    last_month = month_of(F.add_months(newest_route_date(mart), -1))
    cost = F.round(ratio("actual_cost_usd", "planned_stops"), 2)
    return (
        mart.routes.where(F.col("route_month") == last_month)
        .select("route_id", "route_date", "depot_id", "vehicle_id", "planned_stops", cost.alias("cost_per_delivery"))
        .orderBy(F.col("cost_per_delivery").desc_nulls_last(), "route_id")
        .limit(n)
    )


def on_time_by_depot_and_week(mart) -> DataFrame:
    """Completed stops without delay, per depot of the route."""
    weeks = mart.state("stop_states").groupBy("depot_id", "week").agg(
        F.sum("completed").alias("completed_stops"), F.sum("completed_on_time").alias("on_time")
    )
    rate = percent("on_time", "completed_stops").alias("on_time_rate")
    return weeks.where("completed_stops > 0").select("depot_id", "week", "completed_stops", rate).orderBy("depot_id", "week")


def late_regions_with_reasons(mart, top: int = 3) -> DataFrame:
    """Late stops per region with the region's most frequent reasons."""
    late = mart.state("stop_states").where(F.col("order_found") & (F.col("delayed") > 0))
    reasons = late.groupBy("service_region", "delay_reason").agg(F.sum("delayed").alias("reason_stops"))
    # at most one row per region and reason reaches these windows
    region = Window.partitionBy("service_region")
    rank = F.row_number().over(region.orderBy(F.col("reason_stops").desc(), "delay_reason"))
    return (
        reasons.withColumns({"late_stops": F.sum("reason_stops").over(region), "reason_rank": rank})
        .where(F.col("reason_rank") <= top)
        .select("service_region", "late_stops", "delay_reason", "reason_stops", "reason_rank")
        .orderBy(F.col("late_stops").desc(), "service_region", "reason_rank")
    )


def utilization_by_type(mart) -> DataFrame:
    """Routes per vehicle of each class, counting unused vehicles."""
    per_vehicle = mart.routes.groupBy("vehicle_no").agg(F.count(F.lit(1)).alias("routes"))
    return (
        mart.vehicles.select("vehicle_no", "vehicle_type")
        .join(per_vehicle, "vehicle_no", "left")
        .groupBy("vehicle_type")
        .agg(
            F.count(F.lit(1)).alias("vehicles"),
            F.coalesce(F.sum("routes"), F.lit(0)).alias("routes"),
            F.round(ratio(F.coalesce(F.sum("routes"), F.lit(0)), F.count(F.lit(1))), 2).alias("routes_per_vehicle"),
        )
        .orderBy("vehicle_type")
    )


def miles_per_stop_by_depot(mart) -> DataFrame:
    return (
        mart.routes.groupBy("depot_id")
        .agg(F.round(mean_ratio("actual_miles", "planned_stops"), 2).alias("miles_per_stop"))
        .orderBy("miles_per_stop", "depot_id")
    )


def worst_clients_this_quarter(mart) -> DataFrame:
    """On-time rate per client over completed stops of the newest quarter."""
    newest = newest_route_date(mart)
    quarter = F.trunc(newest, "quarter")
    # the client stands on the stop; the month range prunes partitions
    stops = metrics.completed(mart).where(
        F.col("order_found") & (F.col("route_date") >= quarter) & (F.col("route_month") >= month_of(quarter))
    )
    return (
        stops.groupBy("client_id")
        .agg(
            F.count(F.lit(1)).alias("completed_stops"),
            percent(count_if(F.col("delay_minutes") == 0), F.count(F.lit(1))).alias("on_time_rate"),
        )
        .orderBy("on_time_rate", "client_id")
    )


def busiest_depots(mart, n: int = 10) -> DataFrame:
    """Depots by stops served, with carried weight against vehicle capacity."""
    return (
        planning.route_load(mart).groupBy("depot_id")
        .agg(
            F.sum("stops").alias("stops"),
            F.count(F.lit(1)).alias("routes"),
            percent(F.sum("load_weight_lbs"), F.sum("capacity_weight_lbs")).alias("load_pct"),
            count_if(F.col("load_weight_lbs") > F.col("capacity_weight_lbs")).alias("overloaded_routes"),
            count_if(F.col("planned_stops") > F.col("max_stops_per_route")).alias("over_stop_limit"),
        )
        .orderBy(F.col("stops").desc(), "depot_id")
        .limit(n)
    )

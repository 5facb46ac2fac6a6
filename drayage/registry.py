"""Names of all reports, each a function of the mart.

``plain`` turns dates, timestamps, decimals and lists into strings and doubles,
so that results compare column by column with those of another engine.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from drayage.plans import building_blocks as blocks
from drayage.plans import catalog, charts, dashboard, metrics, planning, quality, questions
from drayage.sources.mart import mart_of


def plain(df: DataFrame) -> DataFrame:
    def flat(field):
        c = df[field.name]
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(field.name)

    return df.select([flat(f) for f in df.schema])


def _paths(mart):
    paths = planning.route_paths(mart)
    return paths.select(
        "route_id", "vehicle_type", "piece", F.size("points").alias("points"), planning.path_text().alias("path")
    )


REPORTS = {
    # sources and sinks
    "s1_vehicle_type_dimension": blocks.vehicle_type_dimension,
    "s2_date_spine": blocks.orders_per_day,
    "s3_table_scan": blocks.customer_scan,
    "s3_table_by_name": catalog.table_by_name,
    "s4_tables_present": catalog.tables_present,
    "s5_materialized_vehicles": catalog.materialized_vehicles,
    "s6_incremental_build": catalog.repeated_build,
    "s7_schema_creation": catalog.schema_creation,
    "s8_column_comments": catalog.column_comments,
    "s9_drop_report": catalog.drop_report,
    "s10_build_summary": catalog.build_summary,
    # reusable operators
    "o1_hash_bucket": blocks.order_buckets,
    "o2_sample_by_rate": blocks.sampled_orders,
    "o3_weighted_category": blocks.status_shares,
    "o4_calendar_weight": blocks.weighted_demand,
    "o5_scenario_grid": blocks.demand_grid,
    "o6_jitter": blocks.price_spread,
    "o6_geo_jitter": blocks.customer_places,
    "o7_dense_id": blocks.numbered_orders,
    "o8_first_n": blocks.first_vehicles,
    "o9_expand_rows": blocks.planned_stop_slots,
    "o10_rank_zip_join": blocks.order_assignment,
    "o11_format_id": blocks.customer_labels,
    "o12_time_of_day": blocks.window_hours,
    "o13_profile_by_class": blocks.package_profiles,
    "o14_plan_cost": blocks.planned_costs,
    "o15_plan_duration": blocks.planned_durations,
    "o16_actual_from_plan": blocks.actuals_by_method,
    "o17_stop_timeline": blocks.arrival_hours,
    "o18_delay_model": blocks.delays_observed,
    "o19_capped_stops": blocks.stop_targets,
    "o20_driver_id": blocks.driver_assignments,
    # mart tables
    "t1_vehicles": lambda m: m.fleet,
    "t2_delivery_orders": lambda m: m.orders,
    "t3_route_plans": lambda m: m.routes,
    "t4_route_stops": lambda m: m.stops,
    "t5_depots": lambda m: m.depots,
    # dashboard
    "q01_kpis": dashboard.kpis,
    "q01_kpis_period_depot": lambda m: dashboard.kpis(
        m, start="1996-01-01", end="1997-12-31", depot="DEPOT_NATION_3"
    ),
    "q02_kpis_client": lambda m: dashboard.kpis(m, client="BUILDING"),
    "q03_kpis_region": lambda m: dashboard.kpis(m, region="ASIA"),
    "q04_routes": dashboard.routes,
    "q04_routes_filtered": lambda m: dashboard.routes(m, date="1998-03-01", client="FURNITURE"),
    "q05_route_stops": lambda m: dashboard.route_stops(m, "RT-007-199803"),
    "q06_vehicles": dashboard.vehicles,
    "q06_vehicles_filtered": lambda m: dashboard.vehicles(m, vehicle_type="box_truck"),
    "q07_delays_by_reason": dashboard.delays_by_reason,
    "q08_delays_by_month": dashboard.delays_by_month,
    "q09_delays_by_region": dashboard.delays_by_region,
    "q10_delay_report": dashboard.delay_report,
    "q10_delay_report_filtered": lambda m: dashboard.delay_report(
        m, start="1997-01-01", end="1997-12-31", region="EUROPE"
    ),
    "q11_worst_routes": dashboard.worst_routes,
    "q12_map_stops": dashboard.map_stops,
    "q12_map_stops_box": lambda m: dashboard.map_stops(m, box=(25.0, -110.0, 35.0, -90.0)),
    "q12_map_stops_filtered": lambda m: dashboard.map_stops(m, date="1999-05-01", depot="DEPOT_NATION_3"),
    "q13_depots": dashboard.depot_list,
    "q14_clients": dashboard.client_list,
    "q15_regions": dashboard.region_list,
    "q16_verification": dashboard.verification,
    "q17_cost_by_depot": charts.cost_by_depot,
    "q18_efficiency_trend": charts.efficiency_trend,
    "q19_vehicles_by_status": charts.vehicles_by_status,
    "q20_cost_by_type": lambda m: charts.cost_by_type(m, fleet=m.fleet),
    "q21_vehicle_types": charts.vehicle_types,
    "q22_delay_pivot": charts.delay_pivot,
    "q23_region_bars": charts.region_bars,
    "q23_reason_bars": charts.reason_bars,
    "q24_map_depots": charts.map_depots,
    "q24_map_depot_chosen": lambda m: charts.map_depots(m, depot="DEPOT_NATION_3"),
    "q24_map_bounds": charts.map_bounds,
    "q25_severe_routes": charts.severe_routes,
    # defined metrics and examples
    "m1_on_time_rate": metrics.on_time_rate,
    "m2_cost_per_delivery": metrics.cost_per_delivery,
    "m3_miles_per_stop": metrics.miles_per_stop,
    "m4_fleet_utilization": lambda m: metrics.fleet_utilization(m, start="1998-01-01", end="1998-12-31"),
    "m5_route_efficiency": metrics.route_efficiency,
    "m6_late_rate": metrics.late_rate,
    "e1_cost_by_depot": metrics.cost_by_depot,
    "e2_on_time_by_week": metrics.on_time_by_week,
    "e3_delay_reasons_by_region": metrics.delay_reasons_by_region,
    "e4_routes_by_type": metrics.routes_by_type,
    "e5_plan_vs_actual": metrics.plan_vs_actual,
    "e6_cost_and_miles_by_depot": metrics.cost_and_miles_by_depot,
    # business questions
    "n1_costliest_routes_last_month": questions.costliest_routes_last_month,
    "n2_on_time_by_depot_and_week": questions.on_time_by_depot_and_week,
    "n3_late_regions_with_reasons": questions.late_regions_with_reasons,
    "n4_utilization_by_type": questions.utilization_by_type,
    "n5_miles_per_stop_by_depot": questions.miles_per_stop_by_depot,
    "n6_worst_clients_this_quarter": questions.worst_clients_this_quarter,
    "n7_busiest_depots": questions.busiest_depots,
    # requirements text
    "p1_on_time_by_window": planning.on_time_by_window,
    "p2_late_by_window": planning.late_by_window,
    "p3_straight_line_efficiency": planning.straight_line_efficiency,
    "p4_load_utilization": planning.load_utilization,
    "p5_utilization_heatmap": planning.utilization_heatmap,
    "p6_cost_per_mile_by_fuel": planning.cost_per_mile_by_fuel,
    "p7_capacity_by_type": planning.capacity_by_type,
    "p8_route_paths": _paths,
    "p9_affected_orders": lambda m: planning.affected_orders(m, "weather"),
    "p10_late_rate_by_region": planning.late_rate_by_region,
    "p11_depot_share": planning.depot_share,
    "p12_route_progress": planning.route_progress,
    # data quality
    "d1_row_counts": quality.row_counts,
    "d2_key_checks": quality.key_checks,
    "d3_stops_without_order": quality.stops_without_order,
    "d4_capacity_violations": quality.capacity_violations,
    "d5_domain_checks": quality.domain_checks,
}


def report(name: str):
    """The report as a function of (spark, source directory)."""
    build = REPORTS[name]
    return lambda spark, directory: plain(build(mart_of(spark, directory)))

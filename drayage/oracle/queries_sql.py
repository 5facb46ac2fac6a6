"""Every report as plain SQL, to check the Spark results against."""

from drayage import schemas
from drayage.oracle.mart_sql import draw, mean, miles, pad, pct, rnd, values, with_mart

ROUTE_COLUMNS = """route_no, route_id, CAST(route_date AS VARCHAR) AS route_date, vehicle_no, vehicle_id, driver_id, depot_id, client_mix,
  planned_stops, CAST(planned_miles AS DOUBLE) AS planned_miles,
  CAST(planned_duration_min AS DOUBLE) AS planned_duration_min, CAST(planned_cost_usd AS DOUBLE) AS planned_cost_usd,
  CAST(actual_miles AS DOUBLE) AS actual_miles, CAST(actual_duration_min AS DOUBLE) AS actual_duration_min,
  CAST(actual_cost_usd AS DOUBLE) AS actual_cost_usd, optimization_method, route_month"""

STOP_COLUMNS = """route_stop_id, route_no, route_id, stop_sequence, order_no, order_id, order_found,
  CAST(route_date AS VARCHAR) AS route_date, vehicle_id, depot_id, client_id, service_region, destination_lat, destination_lon,
  strftime(planned_arrival, '%Y-%m-%d %H:%M:%S') AS planned_arrival,
  strftime(actual_arrival, '%Y-%m-%d %H:%M:%S') AS actual_arrival,
  strftime(planned_departure, '%Y-%m-%d %H:%M:%S') AS planned_departure,
  strftime(actual_departure, '%Y-%m-%d %H:%M:%S') AS actual_departure,
  status, delay_minutes, delay_reason, service_time_min, route_month"""

VEHICLE_COLUMNS = """vehicle_no, vehicle_id, vehicle_type, capacity_weight_lbs, capacity_volume_cuft, max_stops_per_route,
  depot_id, fuel_type, CAST(cost_per_mile_usd AS DOUBLE) AS cost_per_mile_usd,
  CAST(daily_fixed_cost_usd AS DOUBLE) AS daily_fixed_cost_usd, status"""

COST_RATIO = "CAST(actual_cost_usd AS DOUBLE) / nullif(CAST(planned_stops AS DOUBLE), 0e0)"
MILES_RATIO = "CAST(actual_miles AS DOUBLE) / nullif(CAST(planned_stops AS DOUBLE), 0e0)"
WEEK = "CAST(CAST(date_trunc('week', planned_arrival) AS DATE) AS VARCHAR)"


def kpis(where: str) -> str:
    return f"""
    , picked AS (SELECT * FROM m_routes r WHERE {where}),
    tallies AS (
      SELECT route_id, count(*) AS total, sum(CASE WHEN delay_minutes = 0 THEN 1 ELSE 0 END) AS on_time,
             sum(CASE WHEN delay_minutes > 15 THEN 1 ELSE 0 END) AS late
      FROM m_stops WHERE route_id IN (SELECT route_id FROM picked) GROUP BY route_id)
    SELECT coalesce({pct('sum(on_time)', 'sum(total)')}, 0e0) AS on_time_rate,
           coalesce({rnd(f'avg({COST_RATIO})', 2)}, 0e0) AS avg_cost_per_delivery,
           coalesce({rnd(f'avg({MILES_RATIO})', 2)}, 0e0) AS avg_miles_per_stop,
           coalesce({pct('count(DISTINCT vehicle_id)', "(SELECT count(*) FROM m_vehicles WHERE status = 'active')")}, 0e0) AS fleet_utilization_pct,
           CAST(coalesce(sum(total), 0) AS BIGINT) AS total_deliveries,
           coalesce({pct('sum(late)', 'sum(total)')}, 0e0) AS late_delivery_rate
    FROM picked LEFT JOIN tallies USING (route_id)"""


def usage(where: str) -> str:
    return f"""
    SELECT v.*, coalesce(n, 0) AS route_count, {rnd('coalesce(miles, 0e0)', 1)} AS avg_miles_per_route,
           {rnd('coalesce(cost, 0e0)', 2)} AS avg_cost_per_route
    FROM (SELECT {VEHICLE_COLUMNS} FROM m_vehicles) v LEFT JOIN (
      SELECT vehicle_id AS vid, count(*) AS n, {mean('actual_miles')} AS miles, {mean('actual_cost_usd')} AS cost
      FROM m_routes GROUP BY vehicle_id) u ON v.vehicle_id = u.vid
    WHERE {where}"""


def delay_data(where: str = "true") -> str:
    return f"""
    , delay_data AS (
      SELECT s.delay_reason, o.service_region, CAST(date_trunc('month', r.route_date) AS DATE) AS month, s.delay_minutes
      FROM m_stops s JOIN m_routes r USING (route_id) JOIN m_orders o ON s.order_id = o.order_id
      WHERE s.delay_minutes > 0 AND {where})"""


AVG_DELAY = rnd(mean("delay_minutes"), 1)
COUNT = "count(*)"


def delay_report(where: str = "true") -> str:
    return f"""{delay_data(where)}
    SELECT 'by_reason' AS category, delay_reason AS label, CAST(NULL AS VARCHAR) AS month, count(*) AS count, {AVG_DELAY} AS avg_delay
    FROM delay_data GROUP BY delay_reason
    UNION ALL
    SELECT 'by_month', delay_reason, CAST(month AS VARCHAR), count(*), {AVG_DELAY} FROM delay_data GROUP BY delay_reason, month
    UNION ALL
    SELECT 'by_region', service_region, NULL, count(*), {AVG_DELAY} FROM delay_data GROUP BY service_region"""


def worst(n: int, extra: str = "") -> str:
    return f"""
    SELECT route_id, r.depot_id, CAST(r.route_date AS VARCHAR) AS route_date, r.vehicle_id,
           CAST(sum(delay_minutes) AS BIGINT) AS total_delay_minutes, count(*) AS delayed_stops{extra}
    FROM m_stops JOIN m_routes r USING (route_id) WHERE delay_minutes > 0
    GROUP BY route_id, r.depot_id, r.route_date, r.vehicle_id
    ORDER BY total_delay_minutes DESC, route_id LIMIT {n}"""


def map_stops(where: str) -> str:
    return f"""
    SELECT r.route_id, r.depot_id, r.vehicle_id, s.stop_sequence, s.order_id, o.destination_lat AS lat,
           o.destination_lon AS lon, o.destination_address AS address, coalesce(s.delay_minutes, 0) AS delay_minutes,
           s.status, CASE WHEN coalesce(s.delay_minutes, 0) = 0 THEN 'green' WHEN s.delay_minutes <= 15 THEN 'gold' ELSE 'red' END AS color
    FROM m_routes r JOIN m_stops s ON r.route_id = s.route_id JOIN m_orders o ON s.order_id = o.order_id
    WHERE {where} ORDER BY r.route_id, s.stop_sequence"""


LOADS = f"""
    , packed AS (SELECT DISTINCT route_id, order_id FROM m_stops),
    weights AS (SELECT route_id, sum(package_weight_lbs) AS weight, sum(package_volume_cuft) AS volume
      FROM packed JOIN m_orders USING (order_id) GROUP BY route_id),
    loads AS (SELECT r.route_id, r.route_date, r.vehicle_id, r.depot_id, r.planned_stops, v.vehicle_type,
        v.capacity_weight_lbs, v.capacity_volume_cuft, v.max_stops_per_route,
        coalesce(weight, 0) AS load_weight_lbs, coalesce(volume, 0) AS load_volume_cuft
      FROM m_routes r LEFT JOIN m_vehicles v ON r.vehicle_id = v.vehicle_id LEFT JOIN weights w ON r.route_id = w.route_id)"""

RELATIONS = [
    ("route_stops.route_id", "m_stops", "m_routes", "route_id"),
    ("route_stops.order_id", "m_stops", "m_orders", "order_id"),
    ("route_plans.vehicle_id", "m_routes", "m_vehicles", "vehicle_id"),
    ("route_plans.depot_id", "m_routes", "m_depots", "depot_id"),
    ("delivery_orders.depot_id", "m_orders", "m_depots", "depot_id"),
    ("vehicles.depot_id", "m_vehicles", "m_depots", "depot_id"),
]

VIEWS = {"vehicles": "m_vehicles", "delivery_orders": "m_orders", "route_plans": "m_routes", "route_stops": "m_stops"}

TABLE_ROWS = ", table_rows AS (" + " UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, count(*) AS row_count, {len(fields)} AS columns,
    {f"count(DISTINCT {schemas.PARTITION_COLUMNS[table]})" if schemas.PARTITION_COLUMNS[table] else "CAST(0 AS BIGINT)"} AS months FROM {VIEWS[table]}"""
    for table, fields in schemas.TABLES.items()
) + ")"

# per column: its comment, and how many rows fill it
COMMENTS = (
    ", said AS (SELECT * FROM ("
    + values((t, f.name, f.metadata["comment"].replace("'", "''")) for t, fields in schemas.TABLES.items() for f in fields)
    + ") AS t(table_name, col, comment)), "
    + ", ".join(
        f"{table}_filled AS (UNPIVOT (SELECT {', '.join(f'count({f.name}) AS {f.name}' for f in fields)} FROM {VIEWS[table]})"
        f" ON COLUMNS(*) INTO NAME col VALUE filled)"
        for table, fields in schemas.TABLES.items()
    )
    + ", filled AS ("
    + " UNION ALL ".join(f"SELECT '{table}' AS table_name, col, filled FROM {table}_filled" for table in schemas.TABLES)
    + ") SELECT table_name, col AS column_name, comment, filled FROM said JOIN filled USING (table_name, col)"
)

_SQL = {
    "s1_vehicle_type_dimension": """
    SELECT t.vehicle_type, t.wt AS base_weight_lbs, t.vol AS base_volume_cuft, t.max_stops AS max_stops_per_route,
           t.fuel AS usual_fuel, count(v.vehicle_id) AS vehicles
    FROM m_types t LEFT JOIN m_vehicles v ON t.vehicle_type = v.vehicle_type GROUP BY ALL""",
    "s2_date_spine": """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(o_orderkey) AS orders
    FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY d""",
    "s3_table_scan": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "s3_table_by_name": f"SELECT {VEHICLE_COLUMNS} FROM m_vehicles",
    "s4_tables_present": """
    SELECT 'vehicles' AS table_name, count(*) > 0 AS present FROM m_vehicles
    UNION ALL SELECT 'delivery_orders', count(*) > 0 FROM m_orders
    UNION ALL SELECT 'route_plans', count(*) > 0 FROM m_routes
    UNION ALL SELECT 'route_stops', count(*) > 0 FROM m_stops
    UNION ALL SELECT 'no_such_table', false""",
    "s5_materialized_vehicles": f"SELECT {VEHICLE_COLUMNS} FROM m_vehicles",
    "s6_incremental_build": f"""
    {TABLE_ROWS}
    SELECT run, table_name, run <> 'again' AS built, row_count, CASE run WHEN 'first' THEN months ELSE 0 END AS months_replaced
    FROM table_rows, (VALUES ('first'), ('again')) AS r(run)""",
    "s7_schema_creation": """
    SELECT vehicle_type, count(*) AS vehicles, false AS present_before, true AS created, true AS created_again
    FROM m_vehicles GROUP BY vehicle_type""",
    "s8_column_comments": COMMENTS,
    "s9_drop_report": """
    SELECT 'route_plans' AS item, 'table' AS kind, count(*) AS rows_before, true AS dropped, false AS present_after FROM m_routes
    UNION ALL SELECT 'vehicles', 'table', count(*), true, false FROM m_vehicles
    UNION ALL SELECT 'schema', 'schema', CAST(NULL AS BIGINT), true, false""",
    "s10_build_summary": f"{TABLE_ROWS} SELECT table_name, row_count, columns, months FROM table_rows",
    "o1_hash_bucket": f"SELECT o_orderkey, CAST({draw('o_orderkey', 'part', 16)} AS INTEGER) AS bucket FROM orders",
    "o2_sample_by_rate": f"""
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE {draw('o_orderkey', 'filter', 1000)} / 1000e0 < CASE o_orderpriority WHEN '1-URGENT' THEN 0.9e0
      WHEN '2-HIGH' THEN 0.6e0 WHEN '3-MEDIUM' THEN 0.3e0 WHEN '4-NOT SPECIFIED' THEN 0.15e0
      WHEN '5-LOW' THEN 0.05e0 ELSE 0e0 END""",
    "o3_weighted_category": f"""
    SELECT priority, status, count(*) AS orders, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY priority)')} AS share_pct
    FROM m_orders GROUP BY priority, status""",
    "o4_calendar_weight": """
    SELECT depot_class, requested_month, count(*) AS orders, CAST(sum(
        CASE WHEN month(requested_date) IN (11, 12) THEN 1.60 WHEN month(requested_date) = 8 THEN 1.30
             WHEN month(requested_date) = 1 THEN 0.70 WHEN month(requested_date) IN (6, 7) THEN 0.85 ELSE 1.00 END
      * CASE dayofweek(requested_date) WHEN 0 THEN 0.10 WHEN 6 THEN 0.35 WHEN 1 THEN 1.15 WHEN 5 THEN 0.90 ELSE 1.00 END
      * CASE depot_class WHEN 'busy' THEN 1.5 WHEN 'regular' THEN 1.1 WHEN 'small' THEN 0.7 ELSE 1.0 END) AS DOUBLE) AS weight
    FROM m_orders LEFT JOIN m_depots USING (depot_id) GROUP BY depot_class, requested_month""",
    "o5_scenario_grid": """
    SELECT d.depot_id, strftime(m.month, '%Y-%m') AS requested_month, u.client_id, count(o.order_id) AS orders
    FROM m_depots d
    CROSS JOIN (SELECT unnest(generate_series(date_trunc('month', min(requested_date)), max(requested_date)::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM m_orders) m
    CROSS JOIN (SELECT DISTINCT c_mktsegment AS client_id FROM customer WHERE c_mktsegment IS NOT NULL) u
    LEFT JOIN m_orders o ON o.depot_id = d.depot_id AND o.client_id = u.client_id AND o.requested_month = strftime(m.month, '%Y-%m')
    GROUP BY ALL
    UNION ALL SELECT depot_id, requested_month, client_id, count(*) FROM m_orders
    WHERE depot_id IS NULL OR client_id IS NULL GROUP BY ALL""",
    "o6_jitter": f"""
    SELECT p_partkey, count(*) AS lines, {rnd('(min(l_extendedprice / l_quantity) / any_value(p_retailprice) - 1) * 100', 2)} AS lowest_pct,
           {rnd('(max(l_extendedprice / l_quantity) / any_value(p_retailprice) - 1) * 100', 2)} AS highest_pct
    FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 0 GROUP BY p_partkey""",
    "o6_geo_jitter": f"""
    , middles AS (SELECT service_region, avg(lat) AS mid_lat, avg(lon) AS mid_lon FROM m_depots GROUP BY service_region)
    SELECT c_custkey, depot_id, lat, lon, {rnd(miles('lat', 'lon', 'mid_lat', 'mid_lon'), 3)} AS miles_from_middle
    FROM customer LEFT JOIN (m_depots JOIN middles USING (service_region)) ON c_nationkey = n_nationkey""",
    "o7_dense_id": f"""
    SELECT o_orderkey, 'ORD-' || {pad('n', 6)} AS order_no
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""",
    "o8_first_n": "SELECT depot_id, vehicle_type, vehicle_id FROM m_vehicles ORDER BY depot_id, vehicle_type, vehicle_id LIMIT 40",
    "o9_expand_rows": "SELECT route_id, CAST(unnest(range(1, planned_stops + 1)) AS BIGINT) AS stop_sequence FROM m_routes",
    "o10_rank_zip_join": """
    , l AS (SELECT s.route_stop_id, r.depot_id, r.route_month,
              row_number() OVER (PARTITION BY r.depot_id, r.route_month ORDER BY s.route_no, s.stop_sequence) AS pair_no
            FROM m_stops s JOIN m_routes r USING (route_id)),
    o AS (SELECT order_id, depot_id, requested_month,
              row_number() OVER (PARTITION BY depot_id, requested_month ORDER BY order_no) AS k FROM m_orders)
    SELECT l.*, o.order_id FROM l LEFT JOIN o ON l.depot_id = o.depot_id AND l.route_month = o.requested_month AND l.pair_no = o.k""",
    "o11_format_id": f"""
    SELECT 'CU-' || {pad('c_custkey', 3)} AS customer_id, c_name || ', ' || n_name AS address
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "o12_time_of_day": "SELECT time_window_start AS opens, time_window_end AS closes, count(*) AS orders FROM m_orders GROUP BY ALL",
    "o13_profile_by_class": """
    SELECT client_id, count(*) AS orders, CAST(sum(package_weight_lbs) AS DOUBLE) AS weight_lbs, CAST(min(package_weight_lbs) AS DOUBLE) AS lightest,
           CAST(max(package_weight_lbs) AS DOUBLE) AS heaviest, CAST(sum(package_volume_cuft) AS DOUBLE) AS volume_cuft
    FROM m_orders GROUP BY client_id""",
    "o14_plan_cost": """
    SELECT vehicle_type, count(*) AS routes, CAST(sum(planned_cost_usd) AS DOUBLE) AS planned_cost_usd
    FROM m_routes r LEFT JOIN m_vehicles v ON r.vehicle_no = v.vehicle_no GROUP BY vehicle_type""",
    "o15_plan_duration": """
    SELECT depot_id, count(*) AS routes, CAST(sum(planned_duration_min) AS DOUBLE) AS planned_duration_min
    FROM m_routes GROUP BY depot_id""",
    "o16_actual_from_plan": "SELECT optimization_method, "
    + ", ".join(
        f"CAST(sum({c}) AS DOUBLE) AS {c}"
        for c in ["planned_miles", "actual_miles", "planned_duration_min", "actual_duration_min", "planned_cost_usd", "actual_cost_usd"]
    )
    + " FROM m_routes GROUP BY optimization_method",
    "o17_stop_timeline": """
    SELECT CAST(hour(planned_arrival) AS INTEGER) AS hour, count(*) AS stops,
           CAST(sum(date_diff('second', planned_arrival, actual_arrival)) AS BIGINT) AS lag_seconds,
           CAST(sum(date_diff('second', actual_arrival, actual_departure)) AS BIGINT) AS dwell_seconds
    FROM m_stops GROUP BY hour(planned_arrival)""",
    "o18_delay_model": """
    SELECT delay_reason AS reason, count(*) AS stops, CAST(sum(delay_minutes) AS BIGINT) AS minutes,
           min(delay_minutes) AS shortest, max(delay_minutes) AS longest
    FROM m_stops GROUP BY delay_reason""",
    "o19_capped_stops": """
    SELECT v.vehicle_id, max_stops_per_route, coalesce(n, 0) AS routes,
           least(max_stops_per_route, CAST(coalesce(ceil(stops / n), 0) AS INTEGER)) AS stop_target
    FROM m_vehicles v LEFT JOIN (SELECT vehicle_no, count(*) AS n, CAST(sum(planned_stops) AS DOUBLE) AS stops FROM m_routes GROUP BY vehicle_no) r
      ON v.vehicle_no = r.vehicle_no""",
    "o20_driver_id": "SELECT driver_id, count(*) AS routes, count(DISTINCT depot_id) AS depots, count(DISTINCT route_month) AS months FROM m_routes GROUP BY driver_id",
    "t1_vehicles": f"SELECT {VEHICLE_COLUMNS} FROM m_fleet",
    "t2_delivery_orders": """
    SELECT order_no, order_id, client_id, depot_id, destination_address, destination_lat, destination_lon,
           CAST(requested_date AS VARCHAR) AS requested_date, window_start_min, window_end_min, time_window_start,
           time_window_end, CAST(package_weight_lbs AS DOUBLE) AS package_weight_lbs,
           CAST(package_volume_cuft AS DOUBLE) AS package_volume_cuft, service_region, priority, status, requested_month
    FROM m_orders""",
    "t3_route_plans": f"SELECT {ROUTE_COLUMNS} FROM m_routes",
    "t4_route_stops": f"SELECT {STOP_COLUMNS} FROM m_stops",
    "t5_depots": "SELECT depot_id, name, lat, lon, service_region, depot_class FROM m_depots",
    "q01_kpis": kpis("true"),
    "q01_kpis_period_depot": kpis(
        "r.route_date >= DATE '1996-01-01' AND r.route_date <= DATE '1997-12-31' AND r.depot_id = 'DEPOT_NATION_3'"
    ),
    "q02_kpis_client": kpis("list_contains(string_split(r.client_mix, ','), 'BUILDING')"),
    "q03_kpis_region": kpis(
        "EXISTS (SELECT 1 FROM m_orders o WHERE o.service_region = 'ASIA' AND o.depot_id = r.depot_id AND o.requested_month = r.route_month)"
    ),
    "q04_routes": f"SELECT {ROUTE_COLUMNS} FROM m_routes ORDER BY m_routes.route_date DESC, depot_id, route_id",
    "q04_routes_filtered": f"""
    SELECT {ROUTE_COLUMNS} FROM m_routes
    WHERE m_routes.route_date = DATE '1998-03-01' AND list_contains(string_split(client_mix, ','), 'FURNITURE')
    ORDER BY m_routes.route_date DESC, depot_id, route_id""",
    "q05_route_stops": f"SELECT {STOP_COLUMNS} FROM m_stops WHERE route_id = 'RT-007-199803'",
    "q06_vehicles": usage("true"),
    "q06_vehicles_filtered": usage("v.vehicle_type = 'box_truck'"),
    "q07_delays_by_reason": f"{delay_data()} SELECT delay_reason AS label, count(*) AS count, {AVG_DELAY} AS avg_delay FROM delay_data GROUP BY delay_reason",
    "q08_delays_by_month": f"{delay_data()} SELECT delay_reason AS label, CAST(month AS VARCHAR) AS month, count(*) AS count, {AVG_DELAY} AS avg_delay FROM delay_data GROUP BY delay_reason, month",
    "q09_delays_by_region": f"{delay_data()} SELECT service_region AS label, count(*) AS count, {AVG_DELAY} AS avg_delay FROM delay_data GROUP BY service_region",
    "q10_delay_report": delay_report(),
    "q10_delay_report_filtered": delay_report(
        "r.route_date >= DATE '1997-01-01' AND r.route_date <= DATE '1997-12-31' AND o.service_region = 'EUROPE'"
    ),
    "q11_worst_routes": worst(10),
    "q12_map_stops": map_stops("true"),
    "q12_map_stops_box": map_stops("o.destination_lat BETWEEN 25 AND 35 AND o.destination_lon BETWEEN -110 AND -90"),
    "q12_map_stops_filtered": map_stops("r.route_date = DATE '1999-05-01' AND r.depot_id = 'DEPOT_NATION_3'"),
    "q13_depots": "SELECT depot_id, lat, lon, name FROM m_depots",
    "q14_clients": "SELECT DISTINCT c_mktsegment AS client_id FROM customer",
    "q15_regions": "SELECT DISTINCT service_region FROM m_orders",
    "q16_verification": f"""
    SELECT 'vehicles' AS metric, CAST(count(*) AS DOUBLE) AS value FROM m_vehicles
    UNION ALL SELECT 'vehicle_types', CAST(count(DISTINCT vehicle_type) AS DOUBLE) FROM m_vehicles
    UNION ALL SELECT 'delivery_orders', CAST(count(*) AS DOUBLE) FROM m_orders
    UNION ALL SELECT 'depots', CAST(count(DISTINCT depot_id) AS DOUBLE) FROM m_orders
    UNION ALL SELECT 'clients', CAST(count(DISTINCT client_id) AS DOUBLE) FROM m_orders
    UNION ALL SELECT 'regions', CAST(count(DISTINCT service_region) AS DOUBLE) FROM m_orders
    UNION ALL SELECT 'route_plans', CAST(count(*) AS DOUBLE) FROM m_routes
    UNION ALL SELECT 'optimization_methods', CAST(count(DISTINCT optimization_method) AS DOUBLE) FROM m_routes
    UNION ALL SELECT 'route_stops', CAST(count(*) AS DOUBLE) FROM m_stops
    UNION ALL SELECT 'late_pct', {pct('sum(CASE WHEN delay_minutes > 0 THEN 1 ELSE 0 END)', COUNT)} FROM m_stops""",
    "q17_cost_by_depot": f"""
    SELECT replace(depot_id, 'DEPOT_', '') AS depot,
           coalesce({rnd('CAST(sum(actual_cost_usd) AS DOUBLE) / nullif(CAST(sum(planned_stops) AS DOUBLE), 0e0)', 2)}, 0e0) AS cost_per_delivery
    FROM m_routes GROUP BY depot_id""",
    "q18_efficiency_trend": f"""
    SELECT CAST(route_date AS VARCHAR) AS period, CAST(sum(planned_stops) AS BIGINT) AS planned_stops,
           {rnd('avg(CASE WHEN coalesce(planned_miles, 0) <> 0 AND coalesce(actual_miles, 0) <> 0 THEN least(100e0, CAST(planned_miles AS DOUBLE) / CAST(actual_miles AS DOUBLE) * 100e0) ELSE 90e0 END)', 1)} AS rate
    FROM m_routes GROUP BY route_date""",
    "q19_vehicles_by_status": "SELECT status, count(*) AS vehicles FROM m_vehicles GROUP BY status",
    "q20_cost_by_type": f"""
    SELECT vehicle_type, {rnd(mean('cost_per_mile_usd'), 2)} AS avg_cost_per_mile,
           CAST(sum((SELECT count(*) FROM m_routes r WHERE r.vehicle_id = v.vehicle_id)) AS BIGINT) AS total_routes
    FROM m_fleet v GROUP BY vehicle_type""",
    "q21_vehicle_types": "SELECT DISTINCT vehicle_type FROM m_vehicles",
    "q22_delay_pivot": f"""{delay_data()}
    SELECT strftime(month, '%Y-%m') AS month, """
    + ", ".join(
        f"CAST(sum(CASE WHEN delay_reason = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS {r}"
        for r in ["traffic", "customer_not_available", "access_issue", "weather", "vehicle_breakdown"]
    )
    + ", CAST(sum(CASE WHEN delay_reason IS NULL OR delay_reason NOT IN ('traffic', 'customer_not_available', 'access_issue', 'weather', 'vehicle_breakdown') THEN 1 ELSE 0 END) AS BIGINT) AS other"
    + " FROM delay_data GROUP BY strftime(month, '%Y-%m')",
    "q23_region_bars": f"{delay_data()} SELECT service_region AS region, count(*) AS delayed_stops, {AVG_DELAY} AS avg_delay FROM delay_data GROUP BY service_region",
    "q23_reason_bars": f"{delay_data()} SELECT delay_reason AS reason, count(*) AS delayed_stops, {AVG_DELAY} AS avg_delay FROM delay_data GROUP BY delay_reason",
    "q24_map_depots": """
    SELECT d.depot_id, d.name, d.lat, d.lon, count(s.route_id) AS stops
    FROM m_depots d LEFT JOIN m_routes r ON d.depot_id = r.depot_id
    LEFT JOIN (SELECT route_id FROM m_stops JOIN m_orders USING (order_id)) s ON r.route_id = s.route_id
    GROUP BY ALL""",
    "q24_map_depot_chosen": """
    SELECT d.depot_id, d.name, d.lat, d.lon, (SELECT count(*) FROM m_stops s JOIN m_routes r ON s.route_no = r.route_no
        JOIN m_orders o ON s.order_no = o.order_no WHERE r.depot_id = d.depot_id) AS stops
    FROM m_depots d WHERE d.depot_id = 'DEPOT_NATION_3'""",
    "q24_map_bounds": """
    SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM (
      SELECT lat, lon FROM m_depots UNION ALL
      SELECT o.destination_lat, o.destination_lon FROM m_stops s JOIN m_routes r USING (route_id) JOIN m_orders o ON s.order_id = o.order_id)
    WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    "q25_severe_routes": worst(10, ", sum(delay_minutes) > 60 AS severe"),
    "m1_on_time_rate": f"SELECT {pct('sum(CASE WHEN delay_minutes = 0 THEN 1 ELSE 0 END)', COUNT)} AS on_time_rate FROM m_stops WHERE status = 'completed'",
    "m2_cost_per_delivery": f"SELECT {rnd(f'avg({COST_RATIO})', 2)} AS cost_per_delivery FROM m_routes",
    "m3_miles_per_stop": f"SELECT {rnd(f'avg({MILES_RATIO})', 2)} AS miles_per_stop FROM m_routes",
    "m4_fleet_utilization": f"""
    SELECT {pct('count(DISTINCT vehicle_id)', "(SELECT count(*) FROM m_vehicles WHERE status = 'active')")} AS fleet_utilization_pct
    FROM m_routes WHERE route_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "m5_route_efficiency": f"""
    SELECT {rnd('avg(CAST(planned_miles AS DOUBLE) / CAST(actual_miles AS DOUBLE)) * 100e0', 1)} AS route_efficiency_pct
    FROM m_routes WHERE actual_miles > 0""",
    "m6_late_rate": f"SELECT {pct('sum(CASE WHEN delay_minutes > 0 THEN 1 ELSE 0 END)', COUNT)} AS late_delivery_rate FROM m_stops WHERE status = 'completed'",
    "e1_cost_by_depot": f"SELECT depot_id, {rnd(f'avg({COST_RATIO})', 2)} AS avg_cost_per_delivery FROM m_routes GROUP BY depot_id",
    "e2_on_time_by_week": f"""
    SELECT {WEEK} AS week, {pct('sum(CASE WHEN delay_minutes = 0 THEN 1 ELSE 0 END)', COUNT)} AS on_time_rate
    FROM m_stops WHERE status = 'completed' GROUP BY {WEEK}""",
    "e3_delay_reasons_by_region": """
    SELECT o.service_region, s.delay_reason, count(*) AS cnt
    FROM m_stops s JOIN m_routes r ON s.route_id = r.route_id JOIN m_orders o ON s.order_id = o.order_id
    WHERE s.delay_reason IS NOT NULL GROUP BY ALL""",
    "e4_routes_by_type": f"""
    SELECT v.vehicle_type, count(DISTINCT r.route_id) AS routes, {rnd(mean('r.actual_miles'), 1)} AS avg_miles
    FROM m_routes r LEFT JOIN m_vehicles v ON v.vehicle_id = r.vehicle_id GROUP BY v.vehicle_type""",
    "e5_plan_vs_actual": f"""
    SELECT optimization_method, {rnd(mean('planned_miles'), 1)} AS avg_planned, {rnd(mean('actual_miles'), 1)} AS avg_actual,
           {rnd(f'avg({COST_RATIO})', 2)} AS cost_per_stop
    FROM m_routes GROUP BY optimization_method""",
    "e6_cost_and_miles_by_depot": f"""
    SELECT depot_id, {rnd(f'avg({COST_RATIO})', 2)} AS avg_cost_per_delivery, {rnd(f'avg({MILES_RATIO})', 2)} AS avg_miles_per_stop
    FROM m_routes GROUP BY depot_id""",
    "n1_costliest_routes_last_month": f"""
    SELECT route_id, CAST(route_date AS VARCHAR) AS route_date, depot_id, vehicle_id, planned_stops, {rnd(COST_RATIO, 2)} AS cost_per_delivery
    FROM m_routes
    WHERE date_trunc('month', m_routes.route_date) = date_trunc('month', (SELECT max(route_date) FROM m_routes)) - INTERVAL 1 MONTH
    ORDER BY cost_per_delivery DESC NULLS LAST, route_id LIMIT 10""",
    "n2_on_time_by_depot_and_week": f"""
    SELECT r.depot_id, {WEEK} AS week, count(*) AS completed_stops,
           {pct('sum(CASE WHEN delay_minutes = 0 THEN 1 ELSE 0 END)', COUNT)} AS on_time_rate
    FROM m_stops JOIN m_routes r USING (route_id) WHERE status = 'completed' GROUP BY r.depot_id, {WEEK}""",
    "n3_late_regions_with_reasons": """
    , tally AS (SELECT o.service_region, s.delay_reason, count(*) AS reason_stops
        FROM m_stops s JOIN m_orders o ON s.order_id = o.order_id WHERE s.delay_minutes > 0 GROUP BY ALL),
    ranked AS (SELECT service_region, CAST(sum(reason_stops) OVER (PARTITION BY service_region) AS BIGINT) AS late_stops, delay_reason, reason_stops,
        CAST(row_number() OVER (PARTITION BY service_region ORDER BY reason_stops DESC, delay_reason) AS INTEGER) AS reason_rank FROM tally)
    SELECT * FROM ranked WHERE reason_rank <= 3""",
    "n4_utilization_by_type": f"""
    SELECT v.vehicle_type, count(DISTINCT v.vehicle_id) AS vehicles, count(r.route_id) AS routes,
           {rnd('CAST(count(r.route_id) AS DOUBLE) / CAST(count(DISTINCT v.vehicle_id) AS DOUBLE)', 2)} AS routes_per_vehicle
    FROM m_vehicles v LEFT JOIN m_routes r ON v.vehicle_id = r.vehicle_id GROUP BY v.vehicle_type""",
    "n5_miles_per_stop_by_depot": f"SELECT depot_id, {rnd(f'avg({MILES_RATIO})', 2)} AS miles_per_stop FROM m_routes GROUP BY depot_id",
    "n6_worst_clients_this_quarter": f"""
    SELECT o.client_id, count(*) AS completed_stops, {pct('sum(CASE WHEN s.delay_minutes = 0 THEN 1 ELSE 0 END)', COUNT)} AS on_time_rate
    FROM m_stops s JOIN m_routes r ON s.route_id = r.route_id JOIN m_orders o ON s.order_id = o.order_id
    WHERE s.status = 'completed' AND r.route_date >= date_trunc('quarter', (SELECT max(route_date) FROM m_routes))
    GROUP BY o.client_id""",
    "n7_busiest_depots": f"""{LOADS},
    stop_counts AS (SELECT route_id, count(*) AS stops FROM m_stops GROUP BY route_id)
    SELECT depot_id, CAST(coalesce(sum(stops), 0) AS BIGINT) AS stops, count(*) AS routes,
           {pct('sum(load_weight_lbs)', 'sum(capacity_weight_lbs)')} AS load_pct,
           CAST(sum(CASE WHEN load_weight_lbs > capacity_weight_lbs THEN 1 ELSE 0 END) AS BIGINT) AS overloaded_routes,
           CAST(sum(CASE WHEN planned_stops > max_stops_per_route THEN 1 ELSE 0 END) AS BIGINT) AS over_stop_limit
    FROM loads LEFT JOIN stop_counts USING (route_id) GROUP BY depot_id ORDER BY stops DESC, depot_id LIMIT 10""",
    "p1_on_time_by_window": f"""
    SELECT client_id, count(*) AS stops, {pct('sum(CASE WHEN actual_arrival BETWEEN day + to_minutes(window_start_min) AND day + to_minutes(window_end_min) THEN 1 ELSE 0 END)', COUNT)} AS on_time_rate
    FROM (SELECT order_id, actual_arrival FROM m_stops WHERE actual_arrival IS NOT NULL)
    JOIN (SELECT *, CAST(requested_date AS TIMESTAMP) AS day FROM m_orders) USING (order_id) GROUP BY client_id""",
    "p2_late_by_window": f"""
    SELECT client_id, count(*) AS stops, {pct('sum(CASE WHEN actual_arrival > day + to_minutes(window_end_min) THEN 1 ELSE 0 END)', COUNT, 3)} AS late_rate
    FROM (SELECT order_id, actual_arrival FROM m_stops WHERE actual_arrival IS NOT NULL)
    JOIN (SELECT *, CAST(requested_date AS TIMESTAMP) AS day FROM m_orders) USING (order_id) GROUP BY client_id""",
    "p3_straight_line_efficiency": f"""
    , points AS (SELECT s.route_id, s.stop_sequence, radians(o.destination_lat) AS lat, radians(o.destination_lon) AS lon
        FROM m_stops s JOIN m_orders o ON s.order_id = o.order_id),
    legs AS (SELECT route_id, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM points
        WINDOW w AS (PARTITION BY route_id ORDER BY stop_sequence)),
    sums AS (SELECT route_id, sum(CAST(2 * 3958.8e0 * asin(sqrt(least(1e0, pow(sin((lat - plat) / 2), 2) + cos(plat) * cos(lat) * pow(sin((lon - plon) / 2), 2)))) AS DECIMAL(18,9))) AS straight
        FROM legs WHERE plat IS NOT NULL GROUP BY route_id)
    SELECT r.route_id, {rnd('straight', 3)} AS straight_miles, CAST(actual_miles AS DOUBLE) AS actual_miles,
           {rnd('CAST(straight AS DOUBLE) / nullif(CAST(actual_miles AS DOUBLE), 0e0) * 100e0', 1)} AS efficiency_pct
    FROM m_routes r LEFT JOIN sums s ON r.route_id = s.route_id""",
    "p4_load_utilization": f"""{LOADS}
    SELECT route_id, vehicle_id, vehicle_type, depot_id, CAST(route_date AS VARCHAR) AS route_date,
           CAST(load_weight_lbs AS DOUBLE) AS load_weight_lbs, CAST(load_volume_cuft AS DOUBLE) AS load_volume_cuft,
           {pct('load_weight_lbs', 'capacity_weight_lbs')} AS weight_pct, {pct('load_volume_cuft', 'capacity_volume_cuft')} AS volume_pct
    FROM loads""",
    "p5_utilization_heatmap": f"""{LOADS}
    SELECT vehicle_id, CAST(route_date AS VARCHAR) AS route_date, count(*) AS routes,
           {pct('sum(load_weight_lbs)', 'sum(capacity_weight_lbs)')} AS utilization_pct
    FROM loads GROUP BY vehicle_id, loads.route_date""",
    "p6_cost_per_mile_by_fuel": f"""
    SELECT vehicle_type, fuel_type, count(*) AS vehicles, {rnd(mean('cost_per_mile_usd'), 2)} AS avg_cost_per_mile
    FROM m_fleet GROUP BY vehicle_type, fuel_type""",
    "p7_capacity_by_type": f"""{LOADS},
    counted AS (SELECT vehicle_type, count(*) AS routes,
        sum(CASE WHEN load_weight_lbs > capacity_weight_lbs OR load_volume_cuft > capacity_volume_cuft THEN 1 ELSE 0 END) AS o,
        sum(CASE WHEN load_weight_lbs * 2 < capacity_weight_lbs AND load_volume_cuft * 2 < capacity_volume_cuft THEN 1 ELSE 0 END) AS u
      FROM loads GROUP BY vehicle_type)
    SELECT vehicle_type, routes, {pct('o', 'routes')} AS over_pct, {pct('u', 'routes')} AS under_pct,
           CASE WHEN o * 2 >= routes THEN 'over' WHEN u * 2 >= routes THEN 'under' ELSE 'balanced' END AS verdict
    FROM counted""",
    "p8_route_paths": """
    SELECT s.route_id, v.vehicle_type, CAST((s.stop_sequence - 1) // 500 AS INTEGER) AS piece, CAST(count(*) AS INTEGER) AS points,
           string_agg(CAST(CAST(o.destination_lat AS DECIMAL(9,3)) AS VARCHAR) || ',' || CAST(CAST(o.destination_lon AS DECIMAL(9,3)) AS VARCHAR), ';' ORDER BY s.stop_sequence) AS path
    FROM m_stops s JOIN m_orders o ON s.order_id = o.order_id JOIN m_routes r ON s.route_id = r.route_id
    LEFT JOIN m_vehicles v ON r.vehicle_id = v.vehicle_id
    GROUP BY s.route_id, v.vehicle_type, (s.stop_sequence - 1) // 500""",
    "p9_affected_orders": """
    SELECT o.order_id, o.client_id, o.depot_id, o.service_region, o.priority, count(*) AS delayed_stops,
           CAST(sum(s.delay_minutes) AS BIGINT) AS delay_minutes
    FROM m_stops s JOIN m_orders o ON s.order_id = o.order_id
    WHERE s.delay_minutes > 0 AND s.delay_reason = 'weather' GROUP BY ALL""",
    "p10_late_rate_by_region": f"""
    SELECT o.service_region, count(*) AS stops, CAST(sum(CASE WHEN s.delay_minutes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS late_stops,
           {pct('sum(CASE WHEN s.delay_minutes > 0 THEN 1 ELSE 0 END)', COUNT, 2)} AS late_rate
    FROM m_stops s JOIN m_orders o ON s.order_id = o.order_id GROUP BY o.service_region""",
    "p11_depot_share": f"""
    , totals AS (SELECT depot_id, count(*) AS orders FROM m_orders GROUP BY depot_id),
    summed AS (SELECT depot_id, orders, sum(orders) OVER () AS total,
        sum(orders) OVER (ORDER BY orders DESC, depot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM totals)
    SELECT depot_id, orders, {pct('orders', 'total', 2)} AS share_pct, {pct('running', 'total', 2)} AS running_share_pct FROM summed""",
    "p12_route_progress": f"""
    , outcomes AS (SELECT route_id AS rid,
        sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN status = 'attempted' THEN 1 ELSE 0 END) AS a,
        sum(CASE WHEN status = 'rescheduled' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS s,
        sum(CASE WHEN status IS NULL OR status NOT IN ('completed', 'attempted', 'rescheduled', 'skipped') THEN 1 ELSE 0 END) AS x
        FROM m_stops GROUP BY route_id)
    SELECT route_id, planned_stops, CAST(coalesce(c, 0) AS BIGINT) AS completed, CAST(coalesce(a, 0) AS BIGINT) AS attempted,
           CAST(coalesce(r, 0) AS BIGINT) AS rescheduled, CAST(coalesce(s, 0) AS BIGINT) AS skipped, CAST(coalesce(x, 0) AS BIGINT) AS other,
           {pct('coalesce(c, 0)', 'planned_stops')} AS completed_pct
    FROM m_routes LEFT JOIN outcomes ON route_id = rid""",
    "d1_row_counts": """
    SELECT 'vehicles' AS table_name, count(*) AS row_count FROM m_vehicles
    UNION ALL SELECT 'delivery_orders', count(*) FROM m_orders
    UNION ALL SELECT 'route_plans', count(*) FROM m_routes
    UNION ALL SELECT 'route_stops', count(*) FROM m_stops""",
    "d2_key_checks": " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", count(DISTINCT {key}) AS missing_keys, count(*) AS rows
        FROM {child} c WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"""
        for name, child, parent, key in [*RELATIONS, ("route_plans without stops", "m_routes", "m_stops", "route_id")]
    )
    + "".join(
        f""" UNION ALL SELECT '{name} is null', least(count(*), 1), count(*) FROM {child} WHERE {key} IS NULL"""
        for name, child, _, key in RELATIONS
    ),
    "d3_stops_without_order": """
    SELECT 'no_order' AS "check", count(*) AS stops FROM m_stops WHERE order_id IS NULL
    UNION ALL SELECT 'unknown_order', count(*) FROM m_stops s
      WHERE order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.order_id = s.order_id)""",
    "d4_capacity_violations": f"""{LOADS},
    flags AS (SELECT route_id, vehicle_id, planned_stops, max_stops_per_route,
        CASE WHEN planned_stops > max_stops_per_route THEN 1 ELSE 0 END AS too_many_stops,
        CASE WHEN load_weight_lbs > capacity_weight_lbs THEN 1 ELSE 0 END AS too_heavy,
        CASE WHEN load_volume_cuft > capacity_volume_cuft THEN 1 ELSE 0 END AS too_large FROM loads)
    SELECT * FROM flags WHERE too_many_stops + too_heavy + too_large > 0""",
    "d5_domain_checks": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS bad_rows FROM {view} WHERE {broken}"
        for table, view, rule, broken in [
            ("vehicles", "m_vehicles", "vehicle_type", "vehicle_type IS NULL OR vehicle_type NOT IN ('sprinter_van','box_truck','26ft_truck','cargo_van','refrigerated_van','flatbed')"),
            ("vehicles", "m_vehicles", "fuel_type", "fuel_type IS NULL OR fuel_type NOT IN ('diesel','gasoline','electric','hybrid')"),
            ("vehicles", "m_vehicles", "status", "status IS NULL OR status NOT IN ('active','maintenance','retired')"),
            ("delivery_orders", "m_orders", "priority", "priority IS NULL OR priority NOT IN ('standard','priority','express')"),
            ("delivery_orders", "m_orders", "status", "status IS NULL OR status NOT IN ('delivered','in_transit','pending','cancelled','returned')"),
            ("delivery_orders", "m_orders", "window_order", "window_start_min >= window_end_min"),
            ("route_plans", "m_routes", "optimization_method", "optimization_method IS NULL OR optimization_method NOT IN ('manual_dispatch','or_tools_cvrp','greedy_nearest')"),
            ("route_stops", "m_stops", "status", "status IS NULL OR status NOT IN ('completed','attempted','rescheduled','skipped')"),
            ("route_stops", "m_stops", "delay_without_reason", "delay_minutes > 0 AND delay_reason IS NULL"),
            ("route_stops", "m_stops", "reason_without_delay", "delay_minutes = 0 AND delay_reason IS NOT NULL"),
            ("route_stops", "m_stops", "unknown_reason", "delay_reason IS NOT NULL AND delay_reason NOT IN ('traffic','customer_not_available','access_issue','weather','vehicle_breakdown')"),
            ("route_stops", "m_stops", "early_arrival", "actual_arrival < planned_arrival"),
        ]
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: with_mart(sql) for name, sql in _SQL.items()}

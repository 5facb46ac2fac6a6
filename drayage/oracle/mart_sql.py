"""The mart as plain SQL common table expressions over the source tables."""

from drayage import fixed_values as fv


def draw(key: str, salt: str, n) -> str:
    """Bucket in [0, n) from the first 32 bits of md5(key|salt)."""
    return f"(CAST('0x' || substr(md5(({key}) || '|{salt}'), 1, 8) AS BIGINT) % {n})"


def pad(number: str, width: int) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"lpad({text}, CAST(greatest(length({text}), {width}) AS INTEGER), '0')"


def rnd(value: str, digits: int) -> str:
    """Round half up on the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST(({value}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def mean(value: str) -> str:
    """Exact sum divided once."""
    return f"(CAST(sum({value}) AS DOUBLE) / CAST(count({value}) AS DOUBLE))"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"CAST({part} AS DOUBLE) * 100e0 / nullif(CAST({whole} AS DOUBLE), 0e0)", digits)


def values(rows) -> str:
    """Literal rows from the fixed values."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


def named(column: str, pairs: dict, other: str) -> str:
    """CASE over the listed values of one column."""
    hits = "".join(f" WHEN '{k}' THEN {repr(v)}" for k, v in pairs.items())
    return f"CASE {column}{hits} ELSE {other} END"


def kinds(pairs: dict) -> str:
    """Rows (return flag, line status, value)."""
    return values((flag, status, value) for (flag, status), value in pairs.items())


def share(salt: str) -> str:
    """A vehicle's own percentage of its class's figure."""
    return f"({100 - fv.VEHICLE_SPREAD} + {draw('vehicle_id', salt, 2 * fv.VEHICLE_SPREAD)})"


def own_rate(column: str, salt: str) -> str:
    return f"CAST(round({column} * CAST({share(salt)} * 0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))"


VEHICLE_NO = "'VH-' || " + pad("s_suppkey", 3)
MILES = "2 * 3958.8e0 * asin(sqrt(least(1e0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


def miles(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance."""
    return MILES.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


CTES = {
    "m_depots": """
      SELECT n_nationkey, 'DEPOT_' || n_name AS depot_id, n_name AS name,
             CAST(25 + (n_nationkey * 7) % 24 AS DOUBLE) AS lat,
             CAST(-120 + (n_nationkey * 11) % 50 AS DOUBLE) AS lon,
             r_name AS service_region,
             CASE WHEN n_nationkey % 8 < 3 THEN 'busy' WHEN n_nationkey % 8 < 5 THEN 'regular' ELSE 'small' END AS depot_class
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "m_types": f"""SELECT * FROM ({values((i, *row) for i, row in enumerate(fv.VEHICLE_TYPES))})
      AS t(type_no, vehicle_type, wt, vol, max_stops, fuel, cpm, fixed)""",
    "m_vehicles": f"""
      SELECT CAST(s_suppkey AS BIGINT) AS vehicle_no, {VEHICLE_NO} AS vehicle_id, vehicle_type,
             CAST(wt AS INTEGER) AS capacity_weight_lbs, CAST(vol AS INTEGER) AS capacity_volume_cuft,
             CAST(max_stops AS INTEGER) AS max_stops_per_route, d.depot_id, fuel AS fuel_type,
             CAST(cpm AS DECIMAL(18,2)) AS cost_per_mile_usd, CAST(fixed AS DECIMAL(18,2)) AS daily_fixed_cost_usd,
             CASE WHEN s_acctbal < {fv.RETIRED_BELOW} THEN 'retired' WHEN s_acctbal < {fv.MAINTENANCE_BELOW} THEN 'maintenance'
                  WHEN s_acctbal >= {fv.MAINTENANCE_BELOW} THEN 'active' END AS status
      FROM supplier LEFT JOIN m_types ON s_suppkey % {len(fv.VEHICLE_TYPES)} = type_no
      LEFT JOIN m_depots d ON s_nationkey = d.n_nationkey""",
    "m_fleet": f"""
      SELECT vehicle_no, vehicle_id, vehicle_type,
             CAST(capacity_weight_lbs * {share('cap_wt')} // 100 AS INTEGER) AS capacity_weight_lbs,
             CAST(capacity_volume_cuft * {share('cap_vol')} // 100 AS INTEGER) AS capacity_volume_cuft,
             max_stops_per_route, depot_id,
             CASE WHEN {draw('vehicle_id', 'fuel', 10)} < 2 THEN 'electric'
                  WHEN {draw('vehicle_id', 'fuel', 10)} = 2 THEN 'hybrid' ELSE fuel_type END AS fuel_type,
             {own_rate('cost_per_mile_usd', 'cpm')} AS cost_per_mile_usd,
             {own_rate('daily_fixed_cost_usd', 'fixed')} AS daily_fixed_cost_usd, status
      FROM m_vehicles""",
    "m_bulk": """
      SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(14,2)) * p_size) AS bulk
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "m_orders": f"""
      SELECT CAST(o_orderkey AS BIGINT) AS order_no, 'ORD-' || {pad('o_orderkey', 6)} AS order_id, c_mktsegment AS client_id,
             d.depot_id, c_name || ', ' || d.name AS destination_address, d.lat AS destination_lat, d.lon AS destination_lon,
             requested_date, window_start_min, window_end_min,
             lpad(CAST(window_start_min // 60 AS VARCHAR), 2, '0') || ':00:00' AS time_window_start,
             lpad(CAST(window_end_min // 60 AS VARCHAR), 2, '0') || ':00:00' AS time_window_end,
             CAST(coalesce(bulk, 0) * {fv.LBS_PER_SIZE} AS DECIMAL(18,2)) AS package_weight_lbs,
             CAST(coalesce(bulk, 0) * {fv.CUFT_PER_SIZE} AS DECIMAL(18,2)) AS package_volume_cuft,
             d.service_region,
             {named('o_orderpriority', fv.PRIORITY_CODES, "'standard'")} AS priority,
             {named('o_orderstatus', fv.STATUS_CODES, "'pending'")} AS status,
             strftime(requested_date, '%Y-%m') AS requested_month
      FROM (SELECT *, CAST(o_orderdate AS DATE) + CAST({named('o_orderpriority', fv.PROMISE_DAYS, str(fv.PROMISE_DAYS_ELSE))} AS INTEGER) AS requested_date,
                   CAST({named('o_orderpriority', {k: w[0] for k, w in fv.WINDOWS.items()}, str(fv.WINDOW_ELSE[0]))} AS INTEGER) AS window_start_min,
                   CAST({named('o_orderpriority', {k: w[1] for k, w in fv.WINDOWS.items()}, str(fv.WINDOW_ELSE[1]))} AS INTEGER) AS window_end_min
            FROM orders)
      LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN m_depots d ON c_nationkey = d.n_nationkey
      LEFT JOIN m_bulk ON o_orderkey = l_orderkey""",
    "m_lines": f"""
      SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1) * 1000000000000 + l_suppkey AS route_no, l_suppkey AS vehicle_no,
             CAST(l_shipdate AS DATE) AS day, CAST(date_trunc('month', l_shipdate) AS DATE) AS route_date,
             l_orderkey AS order_no, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
             {fv.SERVICE_MINUTES} + CAST(floor(l_quantity / {fv.UNITS_PER_MINUTE}) AS INTEGER) AS minutes,
             CAST(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(14,2))) AS DECIMAL(20,4))
               * (1 + CAST(l_tax AS DECIMAL(14,2))) AS DECIMAL(22,6)) AS charge,
             o.order_id IS NOT NULL AS order_found, o.client_id, o.service_region, o.requested_date, o.destination_lat, o.destination_lon
      FROM lineitem LEFT JOIN m_orders o ON l_orderkey = o.order_no""",
    "m_trips": f"""
      SELECT l.route_no, l.vehicle_no, l.route_date, l.destination_lat, l.destination_lon, count(DISTINCT l.day) AS trips,
             count(*) AS stops, sum(l.minutes) AS minutes, sum(l.charge) AS charge,
             CAST({miles('any_value(d.lat)', 'any_value(d.lon)', 'l.destination_lat', 'l.destination_lon')} * 2 AS DECIMAL(18,1)) AS there_and_back
      FROM m_lines l LEFT JOIN m_vehicles v ON l.vehicle_no = v.vehicle_no LEFT JOIN m_depots d ON v.depot_id = d.depot_id
      GROUP BY l.route_no, l.vehicle_no, l.route_date, l.destination_lat, l.destination_lon""",
    "m_mix": """
      SELECT route_no, array_to_string(list_sort(list(DISTINCT client_id)), ',') AS client_mix FROM m_lines GROUP BY route_no""",
    "m_route_sums": """
      SELECT route_no, vehicle_no, route_date, CAST(sum(stops) AS BIGINT) AS planned_stops,
             CAST(sum(there_and_back) AS DECIMAL(18,1)) AS planned_miles, CAST(sum(there_and_back * trips) AS DECIMAL(18,1)) AS actual_miles,
             CAST(sum(minutes) AS BIGINT) AS minutes, sum(charge) AS charge
      FROM m_trips GROUP BY route_no, vehicle_no, route_date""",
    "m_routes": f"""
      SELECT r.route_no, 'RT-' || {pad('r.vehicle_no', 3)} || '-' || strftime(route_date, '%Y%m') AS route_id, route_date,
             r.vehicle_no, 'VH-' || {pad('r.vehicle_no', 3)} AS vehicle_id, 'DRV-' || {pad('r.vehicle_no', 3)} AS driver_id,
             v.depot_id, client_mix, planned_stops, planned_miles,
             CAST(planned_stops * {fv.STOP_MINUTES} + coalesce(planned_miles, 0) * {fv.MINUTES_PER_MILE} AS DECIMAL(18,1)) AS planned_duration_min,
             CAST(round(daily_fixed_cost_usd + planned_miles * cost_per_mile_usd + planned_stops * {fv.STOP_COST_USD}, 2) AS DECIMAL(18,2)) AS planned_cost_usd,
             actual_miles,
             CAST(minutes + coalesce(actual_miles, 0) * {fv.MINUTES_PER_MILE} AS DECIMAL(18,1)) AS actual_duration_min,
             CAST(round(charge * {fv.FREIGHT_SHARE}, 2) AS DECIMAL(18,2)) AS actual_cost_usd,
             CASE WHEN planned_stops <= {fv.MANUAL_STOPS} THEN 'manual_dispatch'
                  WHEN planned_stops <= {fv.GREEDY_STOPS} THEN 'greedy_nearest' ELSE 'or_tools_cvrp' END AS optimization_method,
             strftime(route_date, '%Y-%m') AS route_month
      FROM m_route_sums r LEFT JOIN m_vehicles v ON r.vehicle_no = v.vehicle_no LEFT JOIN m_mix m ON r.route_no = m.route_no""",
    "m_outcomes": f"SELECT * FROM ({kinds(fv.OUTCOMES)}) AS t(flag, line_status, outcome)",
    "m_reasons": f"SELECT * FROM ({kinds(fv.REASONS)}) AS t(flag, line_status, reason)",
    "m_timed": f"""
      SELECT l.*, r.route_id, r.vehicle_id, r.depot_id, r.route_month, outcome, reason,
             CAST(row_number() OVER (PARTITION BY l.route_no
               ORDER BY day, order_no, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS seq,
             CAST(CAST(planned_duration_min * 1000 AS BIGINT) // greatest(planned_stops, 1) AS BIGINT) AS pace,
             CAST(coalesce(greatest(day - requested_date, 0) // {fv.DAYS_PER_DELAY_MINUTE}, 0) AS INTEGER) AS late
      FROM m_lines l LEFT JOIN m_routes r ON l.route_no = r.route_no
      LEFT JOIN m_outcomes o ON l_returnflag = o.flag AND l_linestatus = o.line_status
      LEFT JOIN m_reasons e ON l_returnflag = e.flag AND l_linestatus = e.line_status""",
    "m_stops": f"""
      SELECT 'RS-' || substr(route_id, 4) || '-' || {pad('seq', 3)} AS route_stop_id, route_no, route_id, seq AS stop_sequence,
             order_no, 'ORD-' || {pad('order_no', 6)} AS order_id, order_found, route_date, vehicle_id, depot_id, client_id,
             service_region, destination_lat, destination_lon,
             CAST(day AS TIMESTAMP) + to_minutes(420 + (seq * pace) // 1000) AS planned_arrival,
             CAST(day AS TIMESTAMP) + to_minutes(420 + (seq * pace) // 1000 + late) AS actual_arrival,
             CAST(day AS TIMESTAMP) + to_minutes(420 + (seq * pace) // 1000 + minutes) AS planned_departure,
             CAST(day AS TIMESTAMP) + to_minutes(420 + (seq * pace) // 1000 + minutes + late) AS actual_departure,
             outcome AS status, late AS delay_minutes, CASE WHEN late > 0 THEN reason END AS delay_reason,
             CAST(minutes AS INTEGER) AS service_time_min, route_month
      FROM m_timed""",
}


def with_mart(sql: str) -> str:
    """Prefix the query with the mart expressions it needs, directly or not.

    A query that starts with a comma adds expressions of its own.
    """
    needed, text = set(), sql
    names = list(CTES)
    for name in reversed(names):
        if name in text:
            needed.add(name)
            text += CTES[name]
    if not needed and not sql.strip().startswith(","):
        return sql.strip()
    parts = [f"{n} AS ({CTES[n].strip()})" for n in names if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()

"""Small literal mart with the edge cases of the reports."""

import datetime as dt
from decimal import Decimal as D

from drayage import schemas
from drayage.sources.mart import Mart

DAY = dt.date(2024, 12, 30)  # a Monday of ISO week 2025-W01


def at(day, hour, minute):
    return dt.datetime(day.year, day.month, day.day, hour, minute)


def frame(spark, rows, schema):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def vehicle(n, depot="DEPOT_A", kind="box_truck", status="active", weight=100, volume=100, stops=3, cpm="0.50"):
    return {
        "vehicle_no": n, "vehicle_id": f"V{n}", "vehicle_type": kind, "capacity_weight_lbs": weight, "capacity_volume_cuft": volume,
        "max_stops_per_route": stops, "depot_id": depot, "fuel_type": "diesel", "cost_per_mile_usd": D(cpm),
        "daily_fixed_cost_usd": D("10.00"), "status": status,
    }


def order(n, region="north", client="C1", depot="DEPOT_A", day=DAY, lat=40.0, lon=-75.0, weight="60", volume="10", window=(480, 600)):
    return {
        "order_no": n, "order_id": f"O{n}", "client_id": client, "depot_id": depot, "destination_address": f"{n} Main St",
        "destination_lat": lat, "destination_lon": lon, "requested_date": day, "window_start_min": window[0],
        "window_end_min": window[1], "package_weight_lbs": D(weight), "package_volume_cuft": D(volume),
        "service_region": region, "priority": "standard", "status": "delivered", "requested_month": day.strftime("%Y-%m"),
    }


def route(n, vehicle="V1", depot="DEPOT_A", day=DAY, mix=("C1",), stops=2, miles="10.0", actual="20.0", cost="30.00", method="or_tools_cvrp"):
    return {
        "route_no": n, "route_id": f"R{n}", "route_date": day, "vehicle_no": int(vehicle[1:]), "vehicle_id": vehicle, "driver_id": "D1", "depot_id": depot,
        "client_mix": list(mix), "planned_stops": stops, "planned_miles": miles and D(miles),
        "planned_duration_min": D("60.0"), "planned_cost_usd": D("25.00"), "actual_miles": actual and D(actual),
        "actual_duration_min": D("70.0"), "actual_cost_usd": D(cost), "optimization_method": method,
        "route_month": day.strftime("%Y-%m"),
    }


def stop(route, n, order=None, delay=0, reason=None, status="completed", day=DAY, arrival=(9, 0)):
    planned = at(day, *arrival)
    actual = planned + dt.timedelta(minutes=delay)
    return {
        "route_stop_id": f"{route}-{n}", "route_no": int(route[1:]), "route_id": route, "stop_sequence": n,
        "order_no": order and int(order[1:]), "order_id": order,
        "planned_arrival": planned, "actual_arrival": actual, "planned_departure": planned + dt.timedelta(minutes=5),
        "actual_departure": actual + dt.timedelta(minutes=5), "status": status, "delay_minutes": delay,
        "delay_reason": reason, "service_time_min": 5, "route_month": day.strftime("%Y-%m"),
    }


def depot(name, region="north"):
    return {"depot_id": name, "name": name.lower(), "lat": 41.0, "lon": -74.0, "service_region": region, "depot_class": "busy"}


def make(spark, vehicles=(), orders=(), routes=(), stops=(), depots=(depot("DEPOT_A"), depot("DEPOT_B", "south"))):
    # stops carry what the builders take from their route and order
    by_route, by_order = {r["route_no"]: r for r in routes}, {o["order_no"]: o for o in orders}
    carried = []
    for s in stops:
        own, placed = by_route.get(s["route_no"], {}), by_order.get(s["order_no"], {})
        more = {c: own.get(c) for c in ("route_date", "vehicle_id", "depot_id")}
        more |= {c: placed.get(c) for c in ("client_id", "service_region", "destination_lat", "destination_lon")}
        carried.append(s | more | {"order_found": bool(placed)})
    stops = carried
    return Mart(
        frame(spark, depots, schemas.DEPOTS),
        frame(spark, vehicles, schemas.VEHICLES),
        frame(spark, orders, schemas.DELIVERY_ORDERS),
        frame(spark, routes, schemas.ROUTE_PLANS),
        frame(spark, stops, schemas.ROUTE_STOPS),
    )

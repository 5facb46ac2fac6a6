"""Reports on literal frames: zero denominators, ties, missing keys, edges."""

import datetime as dt

import pytest

from drayage.plans import charts, dashboard, metrics, planning, quality, questions
from tests.frames import DAY, depot, make, order, route, stop, vehicle


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def small(spark):
    jan = dt.date(2025, 1, 6)
    return make(
        spark,
        vehicles=[
            vehicle(1, weight=100, stops=2),
            vehicle(2, kind="flatbed", status="retired", cpm="0.60"),
            vehicle(3, depot="DEPOT_B"),
        ],
        orders=[
            order(1, region="north", client="C1", weight="60", lat=40.0, lon=-75.0),
            order(2, region="north", client="C1", weight="50", lat=40.0, lon=-74.0),
            order(3, region="south", client="C10", depot="DEPOT_B", day=jan, weight="10", lat=None, lon=None),
        ],
        routes=[
            route(1, mix=("C1", "C10"), stops=3, miles="10.0", actual="20.0", cost="30.00"),
            route(2, vehicle="V2", mix=("C10",), stops=0, actual="0.0", cost="7.00"),
            route(3, vehicle="V2", depot="DEPOT_B", day=jan, stops=2, miles="30.0", actual="20.0", cost="40.00"),
            route(4, vehicle="V1", day=jan, mix=(), stops=1, miles=None, actual=None, cost="5.00"),
        ],
        stops=[
            stop("R1", 1, "O1", delay=0),
            stop("R1", 2, "O2", delay=16, reason="weather", status="attempted", arrival=(10, 0)),
            stop("R1", 3, "O1", delay=15, reason="traffic", arrival=(11, 0)),
            stop("R3", 1, "O3", delay=61, reason="weather", day=jan),
            stop("R3", 2, None, delay=1, reason="traffic", day=jan),
            stop("R4", 1, "O9", delay=62, reason="access_issue", day=jan),
        ],
    )


def test_kpis_all_routes(small):
    (row,) = rows(dashboard.kpis(small))
    assert row == {
        "on_time_rate": 16.7,  # 1 of 6
        "avg_cost_per_delivery": 11.67,  # (10 + 20 + 5) / 3, the route without stops has no ratio
        "avg_miles_per_stop": 8.33,  # (6.67 + 10) / 2
        "fleet_utilization_pct": 100.0,  # 2 used, 2 active
        "total_deliveries": 6,
        "late_delivery_rate": 50.0,  # 16, 61 and 62 minutes, not 15
    }


def test_kpis_on_nothing_are_zero(small, spark):
    empty = {
        "on_time_rate": 0.0, "avg_cost_per_delivery": 0.0, "avg_miles_per_stop": 0.0,
        "fleet_utilization_pct": 0.0, "total_deliveries": 0, "late_delivery_rate": 0.0,
    }
    assert rows(dashboard.kpis(small, depot="nowhere")) == [empty]
    no_active = make(spark, vehicles=[vehicle(1, status="retired")], routes=[route(1)])
    assert rows(dashboard.kpis(no_active))[0]["fleet_utilization_pct"] == 0.0
    assert rows(metrics.fleet_utilization(no_active)) == [{"fleet_utilization_pct": None}]


def test_client_filter_matches_whole_names(small):
    assert {r["route_id"] for r in rows(dashboard.routes(small, client="C1"))} == {"R1", "R3"}
    assert {r["route_id"] for r in rows(dashboard.routes(small, client="C10"))} == {"R1", "R2"}


def test_region_filter_goes_by_depot_and_month(small):
    # only DEPOT_B had a southern order, in January
    assert rows(dashboard.kpis(small, region="south"))[0]["total_deliveries"] == 2
    assert rows(dashboard.kpis(small, region="north"))[0]["total_deliveries"] == 3


def test_date_filter_includes_both_ends(small):
    assert rows(dashboard.kpis(small, start="2024-12-30", end="2024-12-30"))[0]["total_deliveries"] == 3
    assert rows(dashboard.kpis(small, start="2024-12-31"))[0]["total_deliveries"] == 3


def test_routes_newest_first_with_total_order(small):
    assert [r["route_id"] for r in rows(dashboard.routes(small))] == ["R4", "R3", "R1", "R2"]
    assert [r["route_id"] for r in rows(dashboard.routes(small, cap=2))] == ["R4", "R3"]


def test_stops_of_route_in_order(small):
    assert [r["stop_sequence"] for r in rows(dashboard.route_stops(small, "R1"))] == [1, 2, 3]
    assert rows(dashboard.route_stops(small, "R1' OR '1'='1")) == []


def test_unused_vehicle_shows_zeros(small):
    usage = {r["vehicle_id"]: (r["route_count"], r["avg_miles_per_route"], r["avg_cost_per_route"]) for r in rows(dashboard.vehicles(small))}
    assert usage == {"V1": (2, 20.0, 17.5), "V2": (2, 10.0, 23.5), "V3": (0, 0.0, 0.0)}
    assert [r["vehicle_id"] for r in rows(dashboard.vehicles(small, depot="DEPOT_B"))] == ["V3"]


def test_delay_report_drops_unmatched_and_equals_its_parts(small):
    report = rows(dashboard.delay_report(small))
    by = lambda category: {(r["label"], r["month"], r["count"], r["avg_delay"]) for r in report if r["category"] == category}
    assert by("by_reason") == {("weather", None, 2, 38.5), ("traffic", None, 1, 15.0)}
    assert by("by_region") == {("north", None, 2, 15.5), ("south", None, 1, 61.0)}
    assert by("by_reason") == {(r["label"], None, r["count"], r["avg_delay"]) for r in rows(dashboard.delays_by_reason(small))}
    assert by("by_month") == {(r["label"], r["month"], r["count"], r["avg_delay"]) for r in rows(dashboard.delays_by_month(small))}
    assert by("by_region") == {(r["label"], None, r["count"], r["avg_delay"]) for r in rows(dashboard.delays_by_region(small))}
    assert sum(r["count"] for r in rows(dashboard.delay_report(small, region="south", start="2025-01-01"))) == 3


def test_delay_pivot_has_every_reason(small):
    pivot = {r["month"]: r for r in rows(charts.delay_pivot(small))}
    assert pivot["2024-12"] == {
        "month": "2024-12", "traffic": 1, "customer_not_available": 0, "access_issue": 0, "weather": 1, "vehicle_breakdown": 0, "other": 0,
    }


def test_worst_routes_break_ties_and_flag_severe(spark):
    mart = make(
        spark,
        routes=[route(1), route(2), route(3)],
        stops=[
            stop("R2", 1, delay=30, reason="weather"), stop("R2", 2, delay=30, reason="weather"),
            stop("R1", 1, delay=60, reason="weather"), stop("R3", 1, delay=61, reason="weather"), stop("R3", 2),
        ],
    )
    worst = rows(charts.severe_routes(mart, n=2))
    assert [(r["route_id"], r["total_delay_minutes"], r["delayed_stops"], r["severe"]) for r in worst] == [
        ("R3", 61, 1, True), ("R1", 60, 1, False),
    ]


def test_map_stops_colours(small):
    found = rows(dashboard.map_stops(small))
    assert [(r["route_id"], r["stop_sequence"], r["color"]) for r in found] == [
        ("R1", 1, "green"), ("R1", 2, "red"), ("R1", 3, "gold"), ("R3", 1, "red"),
    ]
    assert len(rows(dashboard.map_stops(small, depot="DEPOT_B"))) == 1
    assert len(rows(dashboard.map_stops(small, cap=1))) == 1


def test_map_counts_and_bounds(small):
    assert {r["depot_id"]: r["stops"] for r in rows(charts.map_depots(small))} == {"DEPOT_A": 3, "DEPOT_B": 1}
    # the stop without coordinates does not move the box
    assert rows(charts.map_bounds(small)) == [{"min_lat": 40.0, "max_lat": 41.0, "min_lon": -75.0, "max_lon": -74.0}]


def test_cost_by_depot_is_ratio_of_sums(small):
    assert {r["depot"]: r["cost_per_delivery"] for r in rows(charts.cost_by_depot(small))} == {"A": 10.5, "B": 20.0}
    assert rows(charts.cost_by_depot(small, client="C10", start="2024-12-30", end="2024-12-30", depot="DEPOT_A"))[0]["cost_per_delivery"] == 12.33


def test_efficiency_caps_and_defaults(small):
    trend = {str(r["period"]): (r["planned_stops"], r["rate"]) for r in rows(charts.efficiency_trend(small))}
    # R1 50, R2 90 as nothing was driven; R3 150 capped at 100, R4 90 as unknown
    assert trend == {"2024-12-30": (3, 70.0), "2025-01-06": (3, 95.0)}
    weekly = rows(charts.efficiency_trend(small, period="week", last=1))
    assert [str(r["period"]) for r in weekly] == ["2025-01-06"]


def test_vehicle_charts(small):
    assert {r["status"]: r["vehicles"] for r in rows(charts.vehicles_by_status(small))} == {"active": 2, "retired": 1}
    assert {r["vehicle_type"]: (r["avg_cost_per_mile"], r["total_routes"]) for r in rows(charts.cost_by_type(small))} == {
        "box_truck": (0.5, 2), "flatbed": (0.6, 2),
    }


def test_metric_definitions_differ(small):
    # completed stops only: delays 0, 15, 61, 1, 62
    assert rows(metrics.on_time_rate(small)) == [{"on_time_rate": 20.0}]
    assert rows(metrics.late_rate(small)) == [{"late_delivery_rate": 80.0}]
    assert rows(metrics.route_efficiency(small)) == [{"route_efficiency_pct": 100.0}]  # 50 and 150
    assert rows(metrics.cost_per_delivery(small)) == [{"cost_per_delivery": 11.67}]


def test_weeks_start_on_monday_over_new_year(spark):
    mart = make(
        spark,
        routes=[route(1)],
        stops=[
            stop("R1", 1, day=dt.date(2024, 12, 29)),  # Sunday
            stop("R1", 2, day=dt.date(2024, 12, 30)),
            stop("R1", 3, day=dt.date(2025, 1, 5), delay=3, reason="traffic"),
        ],
    )
    assert [(str(r["week"]), r["on_time_rate"]) for r in rows(metrics.on_time_by_week(mart))] == [
        ("2024-12-23", 100.0), ("2024-12-30", 50.0),
    ]


def test_last_month_and_quarter_follow_the_newest_route(small):
    assert [r["route_id"] for r in rows(questions.costliest_routes_last_month(small))] == ["R1", "R2"]
    assert rows(questions.costliest_routes_last_month(small))[1]["cost_per_delivery"] is None
    assert rows(questions.worst_clients_this_quarter(small)) == [
        {"client_id": "C10", "completed_stops": 1, "on_time_rate": 0.0}
    ]


def test_regions_with_reasons(small):
    found = [(r["service_region"], r["late_stops"], r["delay_reason"], r["reason_rank"]) for r in rows(questions.late_regions_with_reasons(small, top=1))]
    assert found == [("north", 2, "traffic", 1), ("south", 1, "weather", 1)]


def test_routes_per_vehicle_counts_unused(small):
    assert {r["vehicle_type"]: r["routes_per_vehicle"] for r in rows(questions.utilization_by_type(small))} == {
        "box_truck": 1.0, "flatbed": 2.0,
    }


def test_busiest_depots(small):
    top = rows(questions.busiest_depots(small))
    assert [(r["depot_id"], r["stops"], r["overloaded_routes"], r["over_stop_limit"]) for r in top] == [
        ("DEPOT_A", 4, 1, 1), ("DEPOT_B", 2, 0, 0),
    ]


def test_window_reports(small):
    # O1 and O2 open 08:00-10:00: arrivals 9:00, 10:16 and 11:15
    assert {r["client_id"]: r["on_time_rate"] for r in rows(planning.on_time_by_window(small))} == {"C1": 33.3, "C10": 0.0}
    assert {r["client_id"]: r["late_rate"] for r in rows(planning.late_by_window(small))} == {"C1": 66.667, "C10": 100.0}


def test_straight_line_efficiency(small):
    found = {r["route_id"]: r for r in rows(planning.straight_line_efficiency(small))}
    # one degree of longitude at 40 N, there and back
    assert found["R1"]["straight_miles"] == pytest.approx(2 * 52.93, abs=0.1)
    assert found["R1"]["efficiency_pct"] == pytest.approx(529.3, abs=1)
    assert found["R3"]["straight_miles"] is None and found["R4"]["efficiency_pct"] is None


def test_load_counts_an_order_once_per_route(small):
    loads = {r["route_id"]: (float(r["load_weight_lbs"]), r["weight_pct"]) for r in rows(planning.load_utilization(small))}
    assert loads == {"R1": (110.0, 110.0), "R2": (0.0, 0.0), "R3": (10.0, 10.0), "R4": (0.0, 0.0)}
    verdicts = {r["vehicle_type"]: r["verdict"] for r in rows(planning.capacity_by_type(small))}
    assert verdicts == {"box_truck": "over", "flatbed": "under"}


def test_route_paths_come_in_pieces(small):
    paths = {(r["route_id"], r["piece"]): [(p.stop_sequence, p.lon) for p in r["points"]] for r in rows(planning.route_paths(small, piece=2))}
    assert paths == {("R1", 0): [(1, -75.0), (2, -74.0)], ("R1", 1): [(3, -75.0)]}


def test_drill_down_and_progress(small):
    assert {r["order_id"]: r["delay_minutes"] for r in rows(planning.affected_orders(small, "weather"))} == {"O2": 16, "O3": 61}
    assert {r["order_id"] for r in rows(planning.affected_orders(small, "weather", start="2025-01-01"))} == {"O3"}
    progress = {r["route_id"]: (r["completed"], r["attempted"], r["completed_pct"]) for r in rows(planning.route_progress(small))}
    assert progress == {"R1": (2, 1, 66.7), "R2": (0, 0, None), "R3": (2, 0, 100.0), "R4": (1, 0, 100.0)}


def test_depot_share_runs_up_to_everything(small):
    assert [(r["depot_id"], r["share_pct"], r["running_share_pct"]) for r in rows(planning.depot_share(small).orderBy("running_share_pct"))] == [
        ("DEPOT_A", 66.67, 66.67), ("DEPOT_B", 33.33, 100.0),
    ]


def test_quality_checks_find_what_is_wrong(small, spark):
    keys = {r["check"]: (r["missing_keys"], r["rows"]) for r in rows(quality.key_checks(small))}
    assert keys["route_stops.order_id"] == (1, 1) and keys["route_plans without stops"] == (1, 1)
    assert keys["route_stops.route_id"] == (0, 0) and keys["vehicles.depot_id"] == (0, 0)
    assert {r["check"]: r["stops"] for r in rows(quality.stops_without_order(small))} == {"no_order": 1, "unknown_order": 1}
    assert [(r["route_id"], r["too_many_stops"], r["too_heavy"]) for r in rows(quality.capacity_violations(small))] == [("R1", 1, 1)]

    broken = make(
        spark,
        vehicles=[vehicle(1, kind="bicycle")],
        routes=[route(1, method="guess")],
        stops=[stop("R1", 1, delay=4), stop("R1", 2, reason="weather"), stop("R1", 3, delay=4, reason="aliens", status="lost")],
    )
    bad = {(r["table_name"], r["rule"]): r["bad_rows"] for r in rows(quality.domain_checks(broken)) if r["bad_rows"]}
    assert bad == {
        ("vehicles", "vehicle_type"): 1, ("route_plans", "optimization_method"): 1, ("route_stops", "status"): 1,
        ("route_stops", "delay_without_reason"): 1, ("route_stops", "reason_without_delay"): 1, ("route_stops", "unknown_reason"): 1,
    }


def test_verification_and_counts(small):
    values = {r["metric"]: r["value"] for r in rows(dashboard.verification(small))}
    assert values["route_stops"] == 6 and values["regions"] == 2 and values["late_pct"] == 83.3
    assert {r["table_name"]: r["row_count"] for r in rows(quality.row_counts(small))} == {
        "vehicles": 3, "delivery_orders": 3, "route_plans": 4, "route_stops": 6,
    }

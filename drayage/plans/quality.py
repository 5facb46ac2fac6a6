"""Checks of keys, capacities and allowed values."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from drayage import fixed_values as fv
from drayage.functions.metrics import count_if
from drayage.plans import planning


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(mart) -> DataFrame:
    tables = {
        "vehicles": mart.vehicles,
        "delivery_orders": mart.orders,
        "route_plans": mart.routes,
        "route_stops": mart.stops,
    }
    return _union(
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    )


#: Key domains: the table that owns the keys, and the columns that refer to them.
DOMAINS = {
    "route_no": ("route_plans", [("route_stops", "route_no")]),
    "order_no": ("delivery_orders", [("route_stops", "order_no")]),
    "vehicle_no": ("vehicles", [("route_plans", "vehicle_no")]),
    "depot_id": ("depots", [("route_plans", "depot_id"), ("delivery_orders", "depot_id"), ("vehicles", "depot_id")]),
}


def _tables(mart) -> dict[str, DataFrame]:
    return {
        "vehicles": mart.vehicles,
        "delivery_orders": mart.orders,
        "route_plans": mart.routes,
        "route_stops": mart.stops,
        "depots": mart.depots,
    }


def key_ledger(mart) -> DataFrame:
    """How often each key stands in each column: domain, key, whether a table owns it, rows per column.

    Every table is scanned once and gives an entry for each of its key columns; one
    aggregation over the entries meets parents and children of all domains.  Tasks add
    up the rows of a key before they leave, so a hot key is a few entries.
    """
    entries = []
    for table, df in _tables(mart).items():
        own = [(d, c, None) for d, (_, uses) in DOMAINS.items() for t, c in uses if t == table]
        own += [(d, d, "parent") for d, (parent, _) in DOMAINS.items() if parent == table]
        listed = F.array(
            *[
                F.struct(
                    F.lit(domain).alias("domain"),
                    (F.col(column) if column.endswith("_no") else F.lit(None).cast("long")).alias("number"),
                    (F.lit(None).cast("string") if column.endswith("_no") else F.col(column)).alias("name"),
                    F.lit(kind or f"{table}.{column}").alias("place"),
                )
                for domain, column, kind in own
            ]
        )
        entries.append(df.select(F.explode(listed).alias("e")).select("e.*"))
    places = [f"{t}.{c}" for _, uses in DOMAINS.values() for t, c in uses]
    here = F.col("place")
    return (
        _union(entries)
        .groupBy("domain", "number", "name")
        .agg(
            F.max(here == "parent").alias("owned"),
            *[F.count(F.when(here == place, 1)).alias(place) for place in places],
        )
    )


#: What each reference is called in the checks: by its id.
CHECK_NAMES = {
    "route_stops.route_no": "route_stops.route_id",
    "route_stops.order_no": "route_stops.order_id",
    "route_plans.vehicle_no": "route_plans.vehicle_id",
}


def key_checks(mart) -> DataFrame:
    """Broken references and missing ones, two rows per relation, and routes without stops."""
    ledger = key_ledger(mart)
    empty, owned = F.col("number").isNull() & F.col("name").isNull(), F.col("owned")
    missing = ~empty & ~owned
    counts, rows = [], []
    for domain, (_, uses) in DOMAINS.items():
        for table, column in uses:
            place = f"{table}.{column}"
            number, inside = F.col(f"`{place}`"), F.col("domain") == domain
            name = CHECK_NAMES.get(place, place)
            for check, wanted in ((name, missing), (f"{name} is null", empty)):
                at = len(counts)
                counts.append(count_if(inside & wanted & (number > 0)).alias(f"k{at}"))
                counts.append(F.coalesce(F.sum(F.when(inside & wanted, number)), F.lit(0)).alias(f"r{at}"))
                rows.append(f"'{check}', k{at}, r{at}")
    idle = (F.col("domain") == "route_no") & owned & ~empty & (F.col("`route_stops.route_no`") == 0)
    counts.append(count_if(idle).alias("idle"))
    rows.append("'route_plans without stops', idle, idle")
    totals = ledger.agg(*counts)
    return totals.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (check, missing_keys, rows)")


def stops_without_order(mart) -> DataFrame:
    """Stops with no order key, and stops whose order is unknown; both stand on the stop."""
    no_key = F.col("order_no").isNull()
    totals = mart.stops.agg(count_if(no_key).alias("a"), count_if(~no_key & ~F.col("order_found")).alias("b"))
    return totals.selectExpr("stack(2, 'no_order', a, 'unknown_order', b) as (check, stops)")


def capacity_violations(mart) -> DataFrame:
    """Routes that exceed the stop, weight or volume limit of their vehicle."""
    loads = planning.route_load(mart)
    too_many = F.col("planned_stops") > F.col("max_stops_per_route")
    too_heavy = F.col("load_weight_lbs") > F.col("capacity_weight_lbs")
    too_large = F.col("load_volume_cuft") > F.col("capacity_volume_cuft")
    return loads.where(too_many | too_heavy | too_large).select(
        "route_id",
        "vehicle_id",
        "planned_stops",
        "max_stops_per_route",
        too_many.cast("int").alias("too_many_stops"),
        too_heavy.cast("int").alias("too_heavy"),
        too_large.cast("int").alias("too_large"),
    )


def _outside(column: str, allowed) -> tuple:
    value = F.col(column)
    return column, count_if(value.isNull() | ~value.isin(*allowed))


def _rules(table: str, df: DataFrame, rules) -> DataFrame:
    names = [n for n, _ in rules]
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    counted = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in rules])
    return counted.selectExpr(f"'{table}' as table_name", f"stack({len(names)}, {pairs}) as (rule, bad_rows)")


def domain_checks(mart) -> DataFrame:
    """Rows per table that break an allowed-value or missing-value rule."""
    delay, reason = F.col("delay_minutes"), F.col("delay_reason")
    return _union(
        [
            _rules(
                "vehicles",
                mart.vehicles,
                [
                    _outside("vehicle_type", [row[0] for row in fv.VEHICLE_TYPES]),
                    _outside("fuel_type", fv.FUEL_TYPES),
                    _outside("status", fv.VEHICLE_STATUSES),
                ],
            ),
            _rules(
                "delivery_orders",
                mart.orders,
                [
                    _outside("priority", fv.PRIORITIES),
                    _outside("status", fv.ORDER_STATUSES),
                    ("window_order", count_if(F.col("window_start_min") >= F.col("window_end_min"))),
                ],
            ),
            _rules("route_plans", mart.routes, [_outside("optimization_method", fv.METHODS)]),
            _rules(
                "route_stops",
                mart.stops,
                [
                    _outside("status", fv.STOP_STATUSES),
                    ("delay_without_reason", count_if((delay > 0) & reason.isNull())),
                    ("reason_without_delay", count_if((delay == 0) & reason.isNotNull())),
                    ("unknown_reason", count_if(reason.isNotNull() & ~reason.isin(*fv.DELAY_REASONS))),
                    ("early_arrival", count_if(F.col("actual_arrival") < F.col("planned_arrival"))),
                ],
            ),
        ]
    )

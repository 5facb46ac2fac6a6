"""The logistics mart: vehicles, delivery orders, route plans and route stops.

Read from the order and line-item tables: a supplier is a vehicle, an order a delivery
order, and the lines a supplier ships in one month form one route with one stop per
line.  Every column comes from a source column, by the rules in fixed_values.py; what
no source holds is null; only ``Mart.fleet`` spreads a vehicle's figures.  Rows that
refer to an unknown supplier, customer or nation stay, with nulls; lines without a
supplier or ship date have no route number.

Keys are whole numbers while rows are joined and grouped, and are written out as ids at
the end.  Lines meet their orders once; those served lines, bucketed by route, make both
the routes and the stops without moving again.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drayage import fixed_values as fv
from drayage import schemas
from drayage.functions import costing
from drayage.functions.calendar import month_of, time_of_day
from drayage.functions.draws import format_id, hash_bucket, jitter
from drayage.operators.joins import lookup_join
from drayage.operators.numbering import number_rows
from drayage.operators.skew import HotKeys, heavy_hitters, hot_keys, hot_keys_of, hot_row_limit
from drayage.plans import states
from drayage.schemas import conform
from drayage.sources import dimensions, layout
from drayage.sources.staging import shared_dir
from drayage.sources.tables import fingerprint, read_source

LINE_ORDER = ["l_shipdate", "order_no", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
#: Vehicles of a month; a route number is the month's number times this, plus the vehicle's.
MONTH_SPAN = 1_000_000_000_000
#: A vehicle has a route a month, and dates have years up to 9999.
MOST_MONTHS = 120_000


def vehicle_id(number):
    return format_id("VH-", number, 3)


def order_id(number):
    return format_id("ORD-", number, 6)


def month_number(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("long")


def route_number(vehicle: Column, date: Column) -> Column:
    return month_number(date) * F.lit(MONTH_SPAN) + vehicle


def route_id(vehicle: Column, date: Column) -> Column:
    return F.concat(format_id("RT-", vehicle, 3), F.lit("-"), F.date_format(date, "yyyyMM"))


def build_vehicles(supplier: DataFrame, depots: DataFrame) -> DataFrame:
    """One vehicle per supplier; its class follows from its number, its state from the account balance."""
    types = dimensions.vehicle_types(supplier.sparkSession)
    fleet = supplier.withColumn("type_no", (F.col("s_suppkey") % len(fv.VEHICLE_TYPES)).cast("int"))
    fleet = fleet.join(types, "type_no", "left").join(depots, fleet.s_nationkey == depots.n_nationkey, "left")
    balance = F.col("s_acctbal")
    state = F.when(balance < fv.RETIRED_BELOW, "retired").when(balance < fv.MAINTENANCE_BELOW, "maintenance")
    table = fleet.select(
        F.col("s_suppkey").cast("long").alias("vehicle_no"),
        vehicle_id(F.col("s_suppkey")).alias("vehicle_id"),
        "vehicle_type",
        F.col("base_weight_lbs").alias("capacity_weight_lbs"),
        F.col("base_volume_cuft").alias("capacity_volume_cuft"),
        "max_stops_per_route",
        "depot_id",
        F.col("usual_fuel").alias("fuel_type"),
        F.col("base_cost_per_mile").alias("cost_per_mile_usd"),
        F.col("base_daily_cost").alias("daily_fixed_cost_usd"),
        state.when(balance.isNotNull(), "active").alias("status"),
    )
    return conform(table, schemas.VEHICLES)


def own_figures(vehicles: DataFrame) -> DataFrame:
    """Vehicles with capacity, fuel and rates of their own, spread around their class's by the vehicle id."""
    key = F.col("vehicle_id")

    def spread(column, salt):
        return jitter(F.col(column), key, salt, fv.VEHICLE_SPREAD)

    draw, reached = hash_bucket(key, "fuel", 10), 0
    fuel = F.when(key.isNull(), F.col("fuel_type"))
    for name, share in fv.OWN_FUELS:
        reached += share
        fuel = fuel.when(draw < reached, name)
    table = vehicles.withColumns(
        {
            "capacity_weight_lbs": F.floor(spread("capacity_weight_lbs", "cap_wt")),
            "capacity_volume_cuft": F.floor(spread("capacity_volume_cuft", "cap_vol")),
            "fuel_type": fuel.otherwise(F.col("fuel_type")),
            "cost_per_mile_usd": F.round(spread("cost_per_mile_usd", "cpm"), 2),
            "daily_fixed_cost_usd": F.round(spread("daily_fixed_cost_usd", "fixed"), 2),
        }
    )
    return conform(table, schemas.VEHICLES)


def requested_date(ordered: Column, priority: Column) -> Column:
    days = F.coalesce(costing.lookup((priority,), fv.PROMISE_DAYS), F.lit(fv.PROMISE_DAYS_ELSE))
    return F.date_add(ordered.cast("date"), days)


def order_bulk(lineitem: DataFrame, part: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Units times part size of every order."""
    lines = lineitem.select("l_orderkey", F.col("l_partkey").cast("long").alias("part_no"), "l_quantity")
    sizes = part.select(F.col("p_partkey").cast("long").alias("part_no"), "p_size")
    sized = lookup_join(lines, sizes, "part_no", "left", hot=hot)
    return sized.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(14,2)") * F.col("p_size")).alias("bulk"))


def build_orders(
    orders: DataFrame, customer: DataFrame, lineitem: DataFrame, part: DataFrame, depots: DataFrame, hot=lambda key: None
) -> DataFrame:
    """``hot`` names the keys of customer_no and part_no that hold too many rows for a task."""
    bulk = order_bulk(lineitem, part, hot("part_no"))
    clients = customer.select(F.col("c_custkey").cast("long").alias("customer_no"), "c_name", "c_nationkey", "c_mktsegment")
    placed = orders.withColumn("customer_no", F.col("o_custkey").cast("long"))
    placed = lookup_join(placed, clients, "customer_no", "left", hot=hot("customer_no"))
    placed = placed.join(depots, placed.c_nationkey == depots.n_nationkey, "left")
    placed = placed.join(bulk, placed.o_orderkey == bulk.l_orderkey, "left")
    carried = F.coalesce("bulk", F.lit(0).cast("decimal(16,2)"))
    priority, day = F.col("o_orderpriority"), requested_date(F.col("o_orderdate"), F.col("o_orderpriority"))
    window = [
        F.coalesce(costing.lookup((priority,), {k: w[i] for k, w in fv.WINDOWS.items()}), F.lit(fv.WINDOW_ELSE[i]))
        for i in (0, 1)
    ]
    table = placed.select(
        F.col("o_orderkey").cast("long").alias("order_no"),
        order_id(F.col("o_orderkey")).alias("order_id"),
        F.col("c_mktsegment").alias("client_id"),
        "depot_id",
        F.concat("c_name", F.lit(", "), "name").alias("destination_address"),
        F.col("lat").alias("destination_lat"),
        F.col("lon").alias("destination_lon"),
        day.alias("requested_date"),
        window[0].alias("window_start_min"),
        window[1].alias("window_end_min"),
        time_of_day(window[0]).alias("time_window_start"),
        time_of_day(window[1]).alias("time_window_end"),
        (carried * F.lit(fv.LBS_PER_SIZE)).alias("package_weight_lbs"),
        (carried * F.lit(fv.CUFT_PER_SIZE)).alias("package_volume_cuft"),
        "service_region",
        F.coalesce(costing.lookup((priority,), fv.PRIORITY_CODES), F.lit("standard")).alias("priority"),
        F.coalesce(costing.lookup((F.col("o_orderstatus"),), fv.STATUS_CODES), F.lit("pending")).alias("status"),
        month_of(day).alias("requested_month"),
    )
    return conform(table, schemas.DELIVERY_ORDERS)


def serve(lineitem: DataFrame, orders: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Every line with its route and what the routes and stops need of its order."""
    vehicle, shipped = F.col("l_suppkey").cast("long"), F.col("l_shipdate")
    lines = lineitem.select(
        route_number(vehicle, shipped).alias("route_no"),
        vehicle.alias("vehicle_no"),
        F.col("l_orderkey").cast("long").alias("order_no"),
        *[c for c in LINE_ORDER if c != "order_no"],
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    carried = orders.select(
        "order_no", "client_id", "service_region", "requested_date", "destination_lat", "destination_lon",
        F.lit(True).alias("order_found"),
    )
    return lookup_join(lines, carried, "order_no", "left", hot=hot)


def build_routes(served: DataFrame, vehicles: DataFrame, depots: DataFrame) -> DataFrame:
    """One route per vehicle and month of shipping.

    Lines are summed by route, place and day first, so a route of any size reaches the
    later steps as a few rows.
    """
    place = ["destination_lat", "destination_lon"]
    route = ["route_no", "vehicle_no", "route_date"]
    price, discount, tax = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax"))
    days = (
        served.withColumn("route_date", F.trunc("l_shipdate", "month"))
        .groupBy(*route, *place, F.col("l_shipdate").cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("stops"),
            F.sum(costing.service_minutes(F.col("l_quantity"))).alias("service"),
            F.sum(costing.freight(price, discount, tax)).alias("freight"),
            F.collect_set("client_id").alias("clients"),
        )
    )
    places = days.groupBy(*route, *place).agg(
        F.sum("stops").alias("stops"),
        F.count(F.lit(1)).alias("trips"),
        F.sum("service").alias("service"),
        F.sum("freight").alias("freight"),
        F.array_distinct(F.flatten(F.collect_list("clients"))).alias("clients"),
    )
    home = depots.select("depot_id", "lat", "lon")
    fleet = vehicles.select("vehicle_no", "depot_id", "cost_per_mile_usd", "daily_fixed_cost_usd").join(home, "depot_id", "left")
    places = places.join(fleet, "vehicle_no", "left")
    miles = costing.round_trip("lat", "lon", *place)
    per_route = [*route, "depot_id", "cost_per_mile_usd", "daily_fixed_cost_usd"]
    routes = places.withColumn("miles", miles).groupBy(*per_route).agg(
        F.sum("stops").alias("planned_stops"),
        F.sum("miles").cast("decimal(18,1)").alias("planned_miles"),
        F.sum(F.col("miles") * F.col("trips")).cast("decimal(18,1)").alias("actual_miles"),
        F.sum("service").alias("service"),
        F.sum("freight").alias("freight"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("clients")))).alias("client_mix"),
    )
    stops, planned, actual = F.col("planned_stops"), F.col("planned_miles"), F.col("actual_miles")
    none = F.lit(0).cast("decimal(18,1)")
    return conform(
        routes.withColumns(
            {
                "route_id": route_id(F.col("vehicle_no"), F.col("route_date")),
                "vehicle_id": vehicle_id(F.col("vehicle_no")),
                "driver_id": costing.driver_id(F.col("vehicle_no")),
                "planned_duration_min": costing.plan_duration(stops, fv.STOP_MINUTES, F.coalesce(planned, none)),
                "planned_cost_usd": costing.plan_cost(
                    F.col("daily_fixed_cost_usd"), planned, F.col("cost_per_mile_usd"), stops
                ),
                "actual_duration_min": F.col("service") + F.coalesce(actual, none) * F.lit(fv.MINUTES_PER_MILE),
                "actual_cost_usd": F.round("freight", 2),
                "optimization_method": costing.layout_method(stops),
                "route_month": month_of(F.col("route_date")),
            }
        ),
        schemas.ROUTE_PLANS,
    )


def build_stops(served: DataFrame, routes: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One stop per line, in shipping order within its route; ``hot`` are the routes too long for a task."""
    stops = number_rows(served.drop("vehicle_no"), LINE_ORDER, ["route_no"], "stop_sequence", hot=hot)
    plan = routes.select(
        "route_no", "route_id", "route_date", "vehicle_id", "depot_id", "planned_stops", "planned_duration_min", "route_month"
    )
    stops = lookup_join(stops, plan, "route_no", "left", hot=hot)
    sequence, kind = F.col("stop_sequence"), (F.col("l_returnflag"), F.col("l_linestatus"))
    stops = stops.withColumns(
        {
            "route_stop_id": F.concat(
                F.lit("RS-"), F.substring("route_id", 4, 60), F.lit("-"), format_id("", sequence, 3)
            ),
            "order_id": order_id(F.col("order_no")),
            "order_found": F.coalesce("order_found", F.lit(False)),
            "delay_minutes": costing.delay_minutes(F.col("requested_date"), F.col("l_shipdate").cast("date")),
            "service_time_min": costing.service_minutes(F.col("l_quantity")),
            "status": costing.lookup(kind, fv.OUTCOMES),
            "offset": costing.minutes_into_route(sequence, F.col("planned_duration_min"), F.col("planned_stops")),
        }
    )
    delay = F.col("delay_minutes")
    stops = stops.withColumns(
        {
            "delay_reason": F.when(delay > 0, costing.lookup(kind, fv.REASONS)),
            **costing.stop_timeline(F.col("l_shipdate").cast("date"), F.col("offset"), delay, F.col("service_time_min")),
        }
    )
    return conform(stops, schemas.ROUTE_STOPS)


class Mart:
    """The mart tables as DataFrames, the states kept for reports, and the heavy keys."""

    def __init__(self, depots, vehicles, orders, routes, stops, clients=None, heavy: dict | None = None, states=None):
        self.depots, self.vehicles = depots, vehicles
        self.orders, self.routes, self.stops = orders, routes, stops
        self._clients = clients
        self._heavy, self._states = heavy, states or {}
        self._hot: dict[tuple, HotKeys | None] = {}

    @property
    def spark(self) -> SparkSession:
        return self.vehicles.sparkSession

    @property
    def clients(self) -> DataFrame:
        return self._clients if self._clients is not None else self.orders.select("client_id").distinct()

    @property
    def fleet(self) -> DataFrame:
        """The vehicles with their own figures; those of ``vehicles`` are their class's."""
        return own_figures(self.vehicles)

    #: Whether months are replaced later on.
    renewed = True

    def state(self, name: str) -> DataFrame:
        """A table of summed-up states (plans/states.py): the stored one, or made from the mart tables."""
        if name not in self._states:
            self._states[name] = states.STATES[name](self)
        return self._states[name]

    def hot(self, table: str, key: str) -> HotKeys | None:
        """Keys of "stops" or "routes" with too many rows for one task; known from the build, else counted once."""
        if (table, key) not in self._hot:
            if self._heavy is not None:
                found = hot_keys_of(self.spark, key, self._heavy.get((table, key), []))
            else:
                found = hot_keys(getattr(self, table), [key])
            self._hot[table, key] = found
        return self._hot[table, key]


class SourceMart(Mart):
    """Mart over a source directory; its tables are written on first use.

    Depots and clients are projections of small inputs and stay lazy.  The four tables
    and the states are written once into the shared folder, as tables of a database of
    their own, and read back by every report.
    """

    renewed = False

    def __init__(self, spark: SparkSession, directory: str):
        self._spark, self.directory = spark, directory
        self._hot, self._states, self._heavy = {}, {}, None
        self._built: dict[str, DataFrame] = {}
        self._sources: dict[str, DataFrame] = {}
        self.database = f"drayage_{uuid.uuid4().hex}"
        self._path = f"{shared_dir(spark)}/drayage-{spark.sparkContext.applicationId}/{self.database}"
        self._buckets = layout.bucket_count(spark, fingerprint(spark, directory)[1] or 0, self.renewed)

    def source(self, name: str) -> DataFrame:
        """A source table; its files are listed and their schema read once."""
        if name not in self._sources:
            self._sources[name] = read_source(self._spark, self.directory, name)
        return self._sources[name]

    @property
    def spark(self):
        return self._spark

    @property
    def depots_by_nation(self) -> DataFrame:
        return dimensions.depots(self.source("nation"), self.source("region"))

    @property
    def depots(self) -> DataFrame:
        return dimensions.depot_table(self.depots_by_nation)

    @property
    def clients(self) -> DataFrame:
        return self.source("customer").select(F.col("c_mktsegment").alias("client_id")).distinct()

    @property
    def heavy(self) -> dict[tuple[str, str], list]:
        """Keys with too many rows, found in the sources before anything is built."""
        if self._heavy is None:
            self._heavy = heavy_keys(self.source("lineitem"), self.source("orders"))
        return self._heavy

    def hot(self, table: str, key: str) -> HotKeys | None:
        self.heavy
        return super().hot(table, key)

    def plan(self, name: str) -> DataFrame:
        """The table as an unexecuted plan over the source and earlier tables."""
        if name == "vehicles":
            return build_vehicles(self.source("supplier"), self.depots_by_nation)
        if name == "delivery_orders":
            return self.orders_of(self.source("orders"), self.source("lineitem"))
        if name == "served_lines":
            return serve(self.source("lineitem"), self.orders, self.hot("stops", "order_no"))
        if name == "route_plans":
            return build_routes(self.served, self.vehicles, self.depots)
        if name == "route_stops":
            return build_stops(self.served, self.routes, self.hot("stops", "route_no"))
        return states.STATES[name](self)

    def orders_of(self, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
        """Delivery orders from source orders and all lines of these."""
        customer, part = self.source("customer"), self.source("part")
        return build_orders(
            orders, customer, lineitem, part, self.depots_by_nation, lambda key: self.hot("sources", key)
        )

    def buckets(self, name: str) -> int | None:
        """Buckets of a table; none where one route is more than a task should hold."""
        if name not in schemas.BUCKET_COLUMNS:
            return None
        long_route = name in ("served_lines", "route_stops") and self.heavy["stops", "route_no"]
        return None if long_route else self._buckets

    def placed(self, name: str) -> bool:
        """Stops come out of the served lines by bucket; places are range-sorted."""
        return name == "stop_places" or (name == "route_stops" and self.buckets(name) is not None)

    def _written(self, name: str) -> DataFrame:
        if name not in self._built:
            rows = self.plan(name)
            self._spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self._path}'")
            self._built[name] = layout.write_table(
                rows,
                f"{self.database}.{name}",
                name,
                self.buckets(name),
                self.placed(name),
                f"{self._path}/{name}",
                folders=self.renewed,
            )
        return self._built[name]

    @property
    def vehicles(self) -> DataFrame:
        return self._written("vehicles")

    @property
    def orders(self) -> DataFrame:
        return self._written("delivery_orders")

    @property
    def served(self) -> DataFrame:
        return self._written("served_lines")

    @property
    def routes(self) -> DataFrame:
        return self._written("route_plans")

    @property
    def stops(self) -> DataFrame:
        return self._written("route_stops")

    def state(self, name: str) -> DataFrame:
        return self._written(name)


def heavy_keys(lineitem: DataFrame, orders: DataFrame) -> dict[tuple[str, str], list]:
    """(table, key) -> keys of the mart with too many rows for a task, and their counts."""
    lines = lineitem.select(
        F.col("l_orderkey").cast("long").alias("order_no"),
        route_number(F.col("l_suppkey").cast("long"), F.col("l_shipdate")).alias("route_no"),
        F.col("l_partkey").cast("long").alias("part_no"),
    )
    of_lines = heavy_hitters(lines, ["order_no", "route_no", "part_no"])
    of_orders = heavy_hitters(orders.select(F.col("o_custkey").cast("long").alias("customer_no")), ["customer_no"])
    of_routes = {"vehicle_no": []}
    if hot_row_limit(lineitem.sparkSession) < MOST_MONTHS:
        routes = lines.select((F.col("route_no") % MONTH_SPAN).alias("vehicle_no"), "route_no").distinct()
        of_routes = heavy_hitters(routes, ["vehicle_no"])
    return {
        ("stops", "order_no"): of_lines["order_no"],
        ("stops", "route_no"): of_lines["route_no"],
        ("sources", "part_no"): of_lines["part_no"],
        ("sources", "customer_no"): of_orders["customer_no"],
        ("routes", "vehicle_no"): of_routes["vehicle_no"],
    }


_marts: dict[tuple, SourceMart] = {}


def mart_of(spark: SparkSession, directory: str) -> SourceMart:
    """The mart of a source directory, rebuilt when its files change."""
    key = (spark.sparkContext.applicationId, directory, fingerprint(spark, directory))
    if key not in _marts:
        _marts[key] = SourceMart(spark, directory)
    return _marts[key]

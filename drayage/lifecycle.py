"""Building, documenting, summarising and dropping the mart in a catalog schema.

A table of the mart is a view of its newest finished version.  A build writes versions
beside those in use, checks them, and then points the views at them; until then, and if
it fails on the way, readers see the old ones.  A manifest says which sources the tables
were made from, month by month: a later build replaces the months that changed and
leaves all others as they are.
"""

import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from drayage import fixed_values as fv
from drayage import schemas
from drayage.functions.calendar import month_of
from drayage.plans import states
from drayage.sources import layout
from drayage.sources.mart import Mart, SourceMart, build_routes, build_stops, requested_date, serve
from drayage.sources.tables import fingerprint, read_table

BUILD_ORDER = ["vehicles", "delivery_orders", "route_plans", "route_stops"]
STATES = list(states.STATES)
MANIFEST, HEAVY = "source_manifest", "heavy_keys"

# Error conditions and SQL state of a missing permission.
DENIED_CONDITIONS = {"INSUFFICIENT_PERMISSIONS", "PERMISSION_DENIED", "UNAUTHORIZED_ACCESS"}
DENIED_STATE = "42501"


def default_schema(spark: SparkSession) -> str:
    """Schema named after the current user, without the mail domain."""
    user = spark.sql("SELECT split(current_user(), '@')[0] AS name").first()["name"]
    return re.sub(r"\W", "_", user)


def table_present(spark: SparkSession, schema: str, table: str) -> bool:
    """The table exists and has at least one row; does not count them all."""
    return spark.catalog.tableExists(f"{schema}.{table}") and not read_table(spark, schema, table).isEmpty()


def _denied(error: PySparkException) -> bool:
    condition = (error.getCondition() or "").split(".")[0]
    return condition in DENIED_CONDITIONS or error.getSqlState() == DENIED_STATE


def ensure_schema(spark: SparkSession, schema: str) -> bool:
    """Create the schema; without the permission an existing one will do."""
    try:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
        return True
    except PySparkException as error:
        if _denied(error) and spark.catalog.databaseExists(schema):
            return False
        raise


# versions


def _quoted(schema: str, name: str) -> str:
    return f"`{schema}`.`{name}`"


def versions(spark: SparkSession, schema: str, table: str) -> list[str]:
    """All versions of a table that the schema holds, finished or not."""
    shown = spark.sql(f"SHOW TABLES IN `{schema}` LIKE '{table}__*'").collect()
    return sorted(r["tableName"] for r in shown if not r["isTemporary"])


def current_version(spark: SparkSession, schema: str, table: str) -> str | None:
    """The version that the view of a table points at."""
    if not spark.catalog.tableExists(f"{schema}.{table}"):
        return None
    if spark.catalog.getTable(f"{schema}.{table}").tableType != "VIEW":
        return None
    shown = spark.sql(f"SHOW TBLPROPERTIES {_quoted(schema, table)}").collect()
    return {r["key"]: r["value"] for r in shown}.get("drayage.version")


def write_version(
    rows: DataFrame, schema: str, table: str, buckets: int | None = None, placed: bool = False, checked: bool = True
) -> str:
    """Write rows as a new version of a table and check it; a version that fails is removed."""
    spark, version = rows.sparkSession, f"{table}__{uuid.uuid4().hex[:12]}"
    seen = Observation()
    try:
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows")) if checked else rows
        written = layout.write_table(counted, _quoted(schema, version), table, buckets, placed)
        if checked:
            check_version(written, table, _observed(seen))
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(schema, version)}")
        raise
    return version


def _observed(seen: Observation) -> int:
    """Rows counted while they were written; a plan that Spark knows to be empty counts nothing."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return 0


def check_version(written: DataFrame, table: str, rows: int) -> None:
    """The version holds every row that was written, under the declared schema."""
    declared = schemas.TABLES.get(table)
    if declared and written.dtypes != [(f.name, f.dataType.simpleString()) for f in declared]:
        raise RuntimeError(f"{table}: columns differ from the declared ones")
    if (found := written.count()) != rows:
        raise RuntimeError(f"{table}: {rows} rows written, {found} found")


def publish(spark: SparkSession, schema: str, table: str, version: str) -> None:
    """Point the view of a table at a version, in one step, with its comments."""
    fields = spark.table(_quoted(schema, version)).schema
    declared = {f.name: f.metadata.get("comment") for f in schemas.TABLES.get(table, [])}
    said = lambda name: f" COMMENT '{_literal(declared[name])}'" if declared.get(name) else ""
    columns = ", ".join(f"`{f.name}`{said(f.name)}" for f in fields)
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(schema, table)} ({columns})"
        f" TBLPROPERTIES ('drayage.version' = '{version}') AS SELECT * FROM {_quoted(schema, version)}"
    )


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def retire(spark: SparkSession, schema: str, table: str, keep: set[str]) -> None:
    """Drop the versions of a table that nobody needs any more."""
    for version in versions(spark, schema, table):
        if version not in keep:
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(schema, version)}")


def materialize(df: DataFrame, schema: str, table: str, overwrite: bool = False, buckets: int | None = None) -> bool:
    """Write df under its declared schema; False if the table was kept.

    The version in use before stays until the next one replaces it, for readers that
    have begun on it.
    """
    spark = df.sparkSession
    if not overwrite and table_present(spark, schema, table):
        return False
    before = current_version(spark, schema, table)
    version = write_version(schemas.conform(df, schemas.TABLES[table]), schema, table, buckets)
    publish(spark, schema, table, version)
    retire(spark, schema, table, {version, before} - {None})
    return True


def add_comments(spark: SparkSession, schema: str) -> int:
    """Set the comment of every mart column; may run any number of times."""
    done = 0
    for table, columns in schemas.TABLES.items():
        publish(spark, schema, table, current_version(spark, schema, table))
        done += len(columns)
    return done


# manifest


@dataclass
class Changes:
    """What differs between the sources and those the tables were made from."""

    everything: bool = False
    #: Months of ship dates whose lines differ at all, or in what an order weighs; months of orders.
    lines: set[str] = field(default_factory=set)
    weights: set[str] = field(default_factory=set)
    orders: set[str] = field(default_factory=set)

    def any(self) -> bool:
        return bool(self.everything or self.lines or self.weights or self.orders)


def _digest(df: DataFrame, source: str, month, columns: list[str]) -> DataFrame:
    """Rows and an order-free digest of some columns per month."""
    each = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return df.groupBy(F.lit(source).alias("source"), F.coalesce(month, F.lit("")).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(each).cast("string").alias("digest")
    )


def source_manifest(mart: SourceMart) -> DataFrame:
    """source, month, rows and digest of everything that the tables are made from.

    One pass over the columns in use.  Lines have two digests: all columns, and those
    that an order's weight comes from.
    """
    lines, orders = mart.source("lineitem"), mart.source("orders")
    shipped = month_of(F.col("l_shipdate"))
    whole = F.lit(None).cast("string")
    parts = [
        _digest(lines, "lines", shipped, lines.columns),
        _digest(lines, "weights", shipped, ["l_orderkey", "l_partkey", "l_quantity"]),
        _digest(orders, "orders", month_of(F.col("o_orderdate")), orders.columns),
    ]
    for name in ("supplier", "customer", "part", "nation", "region"):
        rows = mart.source(name)
        parts.append(_digest(rows, name, whole, rows.columns))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def changes(before: DataFrame, now: DataFrame) -> Changes:
    """Compare two manifests; both have a row for each source and month."""
    key = ["source", "month"]
    old = before.select(*key, F.struct("rows", "digest").alias("old"))
    both = now.select(*key, F.struct("rows", "digest").alias("new")).join(old, key, "full")
    found = Changes()
    for r in both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*key).collect():
        if r.source in ("lines", "weights", "orders"):
            getattr(found, r.source).add(r.month)
        else:
            found.everything = True
    return found


def later_months(month: str, days: int) -> set[str]:
    """The month and those that a date in it reaches after so many days at most."""
    year, number = int(month[:4]), int(month[5:])
    reach = 1 + -(-days // 28)
    return {f"{year + (number - 1 + i) // 12:04d}-{(number - 1 + i) % 12 + 1:02d}" for i in range(reach + 1)}


# builds


class _Building(SourceMart):
    """Source mart whose tables are versions being built, or those in use."""

    renewed = True

    def __init__(self, spark: SparkSession, directory: str, schema: str):
        super().__init__(spark, directory)
        self.schema = schema
        self.new: dict[str, str] = {}

    def _written(self, name: str) -> DataFrame:
        if name in self.new:
            return read_table(self._spark, self.schema, self.new[name])
        if name == "served_lines":
            self.make(name)
            return self._written(name)
        return read_table(self._spark, self.schema, name)

    def make(self, name: str) -> None:
        rows = self.plan(name)
        if name in schemas.TABLES:
            rows = schemas.conform(rows, schemas.TABLES[name])
        # served lines are read by the builds alone, whose results are checked
        checked = name != "served_lines"
        self.new[name] = write_version(rows, self.schema, name, self.buckets(name), self.placed(name), checked)

    def note(self, name: str, rows: DataFrame) -> None:
        """Write a table of notes about the build."""
        version = f"{name}__{uuid.uuid4().hex[:12]}"
        rows.write.saveAsTable(_quoted(self.schema, version))
        self.new[name] = version


def _heavy_rows(mart: SourceMart) -> DataFrame:
    rows = [(t, k, key, n) for (t, k), keys in mart.heavy.items() for key, n in keys]
    return mart.spark.createDataFrame(rows, "table_name string, key_name string, key long, rows long")


def _heavy_of(spark: SparkSession, schema: str) -> dict:
    found: dict[tuple[str, str], list] = {}
    for r in read_table(spark, schema, HEAVY).collect():
        found.setdefault((r.table_name, r.key_name), []).append((r.key, r["rows"]))
    return found


def _long_routes(heavy: dict) -> bool:
    return bool(heavy.get(("stops", "route_no")))


def build(spark: SparkSession, directory: str, schema: str | None = None, overwrite: bool = False) -> dict:
    """Build or renew the four tables and their states from a source directory.

    Says which tables were built, and for each the months that were replaced.  Sources
    whose files are the ones of the last build are not read.  A build that is stopped
    leaves the tables as they were, but for the months replaced so far; as its manifest
    is written last, the next build does them again.
    """
    schema = schema or default_schema(spark)
    ensure_schema(spark, schema)
    mart = _Building(spark, directory, schema)
    files = str(fingerprint(spark, directory))
    absent = [t for t in BUILD_ORDER if not table_present(spark, schema, t)]
    before_build = {name: current_version(spark, schema, name) for name in [*BUILD_ORDER, *STATES, MANIFEST, HEAVY]}
    noted = spark.catalog.tableExists(f"{schema}.{MANIFEST}") and spark.catalog.tableExists(f"{schema}.{HEAVY}")
    report = {"schema": schema, "tables": list(BUILD_ORDER), "built": [], "months": {}}

    before = read_table(spark, schema, MANIFEST) if noted else None
    same_files = noted and not before.where((F.col("source") == "files") & (F.col("digest") == files)).isEmpty()
    try:
        if not overwrite and same_files:
            if absent:
                _rebuild(mart, absent, report)
                _commit(mart)
            return report
        now = source_manifest(mart)
        rest = Changes(everything=True)
        if not overwrite and noted and not absent:
            rest = changes(before.where("source <> 'files'"), now)
            rest.everything |= _long_routes(mart.heavy) != _long_routes(_heavy_of(spark, schema))
        if rest.everything:
            _rebuild(mart, BUILD_ORDER, report)
        elif rest.any():
            _renew(mart, rest, report)
        mart.note(HEAVY, _heavy_rows(mart))
        mark = spark.createDataFrame([("files", "", 0, files)], "source string, month string, rows long, digest string")
        mart.note(MANIFEST, now.unionByName(mark))
        _commit(mart)
    finally:
        for name in [*BUILD_ORDER, *STATES, "served_lines", MANIFEST, HEAVY]:
            # a version that was in use stays one build longer, for readers that have begun on it
            retire(spark, schema, name, {current_version(spark, schema, name), before_build.get(name)})
    return report


def _rebuild(mart: _Building, tables: list[str], report: dict) -> None:
    """Whole new versions of some tables, and of the states made from them."""
    for table in BUILD_ORDER:
        if table in tables:
            mart.make(table)
            report["built"].append(table)
            month = schemas.PARTITION_COLUMNS[table]
            report["months"][table] = (
                sorted(r[0] for r in mart._written(table).select(month).distinct().collect() if r[0]) if month else []
            )
    for name in STATES:
        if states.MONTHS[name][1] in tables or not mart.spark.catalog.tableExists(f"{mart.schema}.{name}"):
            mart.make(name)


def _renew(mart: _Building, rest: Changes, report: dict) -> None:
    """Replace the months that changes in the sources reach."""
    spark, schema = mart.spark, mart.schema
    lines, orders = mart.source("lineitem"), mart.source("orders")
    shipped = month_of(F.col("l_shipdate"))
    number = F.col("l_orderkey").cast("long").alias("order_no")

    # orders: those that changed, and those with lines that weigh otherwise now or did before
    asked: set[str] = set()
    longest = max(*fv.PROMISE_DAYS.values(), fv.PROMISE_DAYS_ELSE)
    for month in rest.orders - {""}:
        asked |= later_months(month, longest)
    if rest.weights:
        touched = lines.where(shipped.isin(sorted(rest.weights))).select(number)
        gone = layout.of_months(mart.stops, "route_stops", rest.weights).select("order_no")
        hit = mart.orders.join(touched.unionByName(gone).distinct(), "order_no", "left_semi")
        asked |= {r[0] for r in hit.select("requested_month").distinct().collect()}

    # routes and stops: lines that changed, and lines of orders that did or have gone
    months = set(rest.lines)
    if rest.orders:
        moved = orders.where(month_of(F.col("o_orderdate")).isin(sorted(rest.orders)))
        moved = moved.select(F.col("o_orderkey").cast("long").alias("order_no"))
        before = layout.of_months(mart.orders, "delivery_orders", asked).select("order_no")
        hit = lines.select(number, shipped.alias("month")).join(moved.unionByName(before).distinct(), "order_no", "left_semi")
        months |= {r[0] for r in hit.select("month").distinct().collect()}

    if asked:
        day = requested_date(F.col("o_orderdate"), F.col("o_orderpriority"))
        some = orders.where(month_of(day).isin(sorted(m for m in asked if m)))
        theirs = lines.join(some.select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
        _replace(mart, "delivery_orders", mart.orders_of(some, theirs), asked, report)
    if months:
        some = lines.where(F.coalesce(shipped, F.lit("")).isin(sorted(months)))
        rows = serve(some, mart.orders, mart.hot("stops", "order_no"))
        mart.new["served_lines"] = write_version(rows, schema, "served_lines", mart.buckets("served_lines"), False, False)
        _replace(mart, "route_plans", build_routes(mart.served, mart.vehicles, mart.depots), months, report)
        # the stops of these months meet the routes just written
        routes = layout.of_months(mart.routes, "route_plans", months)
        _replace(mart, "route_stops", build_stops(mart.served, routes, mart.hot("stops", "route_no")), months, report)

    # states are a few rows a month: those of the months are made anew, the others copied
    for name in STATES:
        month, table = states.MONTHS[name]
        if table not in report["months"]:
            continue
        changed = set(report["months"][table])
        part = Mart(
            mart.depots,
            mart.vehicles,
            layout.of_months(mart.orders, "delivery_orders", changed),
            layout.of_months(mart.routes, "route_plans", changed),
            layout.of_months(mart.stops, "route_stops", changed),
        )
        rows = states.STATES[name](part)
        if schemas.PARTITION_COLUMNS[name]:
            in_use = _quoted(schema, current_version(spark, schema, name))
            layout.replace_months(rows, in_use, name, changed, None, placed=True)
        else:
            old = read_table(spark, schema, name).where(~F.col(month).isin(sorted(changed)))
            mart.new[name] = write_version(old.unionByName(rows), schema, name)


def _replace(mart: _Building, table: str, rows: DataFrame, months: set[str], report: dict) -> None:
    in_use = _quoted(mart.schema, current_version(mart.spark, mart.schema, table))
    rows = schemas.conform(rows, schemas.TABLES[table])
    layout.replace_months(rows, in_use, table, {m for m in months if m}, mart.buckets(table))
    report["built"].append(table)
    report["months"][table] = sorted(m for m in months if m)


def _commit(mart: _Building) -> None:
    """Point all views at the new versions; the manifest comes last."""
    order = [*BUILD_ORDER, *STATES, HEAVY, MANIFEST]
    for name in order:
        if name in mart.new:
            publish(mart.spark, mart.schema, name, mart.new[name])


def open_mart(spark: SparkSession, schema: str, depots: DataFrame) -> Mart:
    """The mart over catalog tables, for the reports; their heavy keys are read here, once."""
    vehicles, orders, routes, stops = (read_table(spark, schema, t) for t in BUILD_ORDER)
    known = {name: read_table(spark, schema, name) for name in STATES}
    return Mart(depots, vehicles, orders, routes, stops, heavy=_heavy_of(spark, schema), states=known)


def build_summary(spark: SparkSession, schema: str) -> DataFrame:
    """Rows, columns and months of each table of the schema."""
    parts = []
    for table in BUILD_ORDER:
        df, month = read_table(spark, schema, table), schemas.PARTITION_COLUMNS[table]
        months = F.countDistinct(month) if month else F.lit(0).cast("long")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count"), months.alias("months")).select(
                F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("columns"), "months"
            )
        )
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return summary


def drop(spark: SparkSession, schema: str) -> dict:
    """Drop the tables, newest first, then the schema; reports what was done.

    Only what builds have made goes: a schema that holds anything else stays.
    """
    report = {"tables_dropped": [], "schema_dropped": False, "errors": {}}
    there = spark.catalog.databaseExists(schema)
    for table in [MANIFEST, HEAVY, *reversed(STATES), *reversed(BUILD_ORDER)]:
        try:
            if there and spark.catalog.tableExists(f"{schema}.{table}"):
                kind = "VIEW" if spark.catalog.getTable(f"{schema}.{table}").tableType == "VIEW" else "TABLE"
                spark.sql(f"DROP {kind} IF EXISTS {_quoted(schema, table)}")
            if there:
                retire(spark, schema, table, set())
            if table in BUILD_ORDER:
                report["tables_dropped"].append(table)
        except AnalysisException as error:
            report["errors"][table] = str(error)
    try:
        spark.sql(f"DROP SCHEMA IF EXISTS `{schema}` RESTRICT")
        report["schema_dropped"] = True
    except PySparkException as error:
        report["errors"][schema] = str(error)
    return report

"""The life of the mart in a catalog, as reports: build, scan by name, comments, drop.

Each report works in schemas of its own, made from the mart's source directory in the
session's catalog; the one that several share is built once.
"""

import uuid

from pyspark.sql import DataFrame, functions as F

from drayage import lifecycle, schemas
from drayage.sources.tables import read_table

#: The shared schema of each mart, and what its first build reported.
_built: dict[str, tuple[str, dict]] = {}


def scratch(mart) -> str:
    return f"{mart.database}_{uuid.uuid4().hex[:8]}"


def first_build(mart) -> tuple[str, dict]:
    if mart.database not in _built:
        schema = scratch(mart)
        _built[mart.database] = schema, lifecycle.build(mart.spark, mart.directory, schema)
    return _built[mart.database]


def stored(mart) -> str:
    """The schema that holds this mart's tables."""
    return first_build(mart)[0]


def table_by_name(mart, table: str = "vehicles") -> DataFrame:
    return read_table(mart.spark, stored(mart), table)


def tables_present(mart) -> DataFrame:
    """Which tables are there and hold rows."""
    spark, schema = mart.spark, stored(mart)
    names = [*lifecycle.BUILD_ORDER, "no_such_table"]
    rows = [(name, lifecycle.table_present(spark, schema, name)) for name in names]
    return spark.createDataFrame(rows, "table_name string, present boolean")


def materialized_vehicles(mart) -> DataFrame:
    """Vehicles written under their declared schema, replaced once, and read by name."""
    spark, schema = mart.spark, scratch(mart)
    lifecycle.ensure_schema(spark, schema)
    lifecycle.materialize(mart.vehicles, schema, "vehicles")
    lifecycle.materialize(read_table(spark, schema, "vehicles"), schema, "vehicles", overwrite=True)
    return read_table(spark, schema, "vehicles")


def repeated_build(mart) -> DataFrame:
    """What the first build and one after it do to each table."""
    spark, (schema, first) = mart.spark, first_build(mart)
    runs = [("first", first), ("again", lifecycle.build(spark, mart.directory, schema))]
    rows = [
        (run, table, table in report["built"], len(report["months"].get(table, [])))
        for run, report in runs
        for table in lifecycle.BUILD_ORDER
    ]
    done = spark.createDataFrame(rows, "run string, table_name string, built boolean, months_replaced long")
    return done.join(lifecycle.build_summary(spark, schema).select("table_name", "row_count"), "table_name")


def schema_creation(mart) -> DataFrame:
    """A schema made twice, and the vehicles stored in it, by class."""
    spark, schema = mart.spark, scratch(mart)
    before = spark.catalog.databaseExists(schema)
    created = [lifecycle.ensure_schema(spark, schema) and spark.catalog.databaseExists(schema) for _ in range(2)]
    lifecycle.materialize(mart.vehicles, schema, "vehicles")
    counts = read_table(spark, schema, "vehicles").groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("vehicles"))
    return counts.withColumns(
        {"present_before": F.lit(before), "created": F.lit(created[0]), "created_again": F.lit(created[1])}
    )


def column_comments(mart) -> DataFrame:
    """The comment of every column as the catalog gives it, and how many rows fill the column."""
    spark, schema = mart.spark, stored(mart)
    lifecycle.add_comments(spark, schema)
    parts = []
    for table in schemas.TABLES:
        df = read_table(spark, schema, table)
        said = spark.sql(f"DESCRIBE `{schema}`.`{table}`").where("NOT startswith(col_name, '#')")
        said = said.select(F.lit(table).alias("table_name"), F.col("col_name").alias("column_name"), "comment").distinct()
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        filled = counts.unpivot([], df.columns, "column_name", "filled")
        parts.append(said.join(filled, "column_name").select("table_name", "column_name", "comment", "filled"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def drop_report(mart) -> DataFrame:
    """What dropping a schema with two tables does to each and to the schema."""
    spark, schema = mart.spark, scratch(mart)
    lifecycle.ensure_schema(spark, schema)
    counts = {}
    for table, rows in (("vehicles", mart.vehicles), ("route_plans", mart.routes)):
        lifecycle.materialize(rows, schema, table)
        counts[table] = read_table(spark, schema, table).count()
    report = lifecycle.drop(spark, schema)
    rows = [
        (table, "table", n, table in report["tables_dropped"], spark.catalog.tableExists(f"{schema}.{table}"))
        for table, n in counts.items()
    ]
    rows.append(("schema", "schema", None, report["schema_dropped"], spark.catalog.databaseExists(schema)))
    return spark.createDataFrame(rows, "item string, kind string, rows_before long, dropped boolean, present_after boolean")


def build_summary(mart) -> DataFrame:
    """Rows, columns and months of each table that the build has stored."""
    return lifecycle.build_summary(mart.spark, stored(mart))

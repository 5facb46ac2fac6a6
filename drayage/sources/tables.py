"""Reading the input tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

SOURCE_TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


def read_source(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, schema: str, name: str) -> DataFrame:
    """Catalog scan by schema and table name."""
    return spark.table(f"`{schema}`.`{name}`")


def fingerprint(spark: SparkSession, directory: str) -> tuple:
    """Number, size and newest change of the input files (a listing, no data)."""
    paths = [f"{directory.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    row = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").cast("string").alias("changed"),
    ).first()
    return tuple(row)

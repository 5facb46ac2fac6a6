"""Mart tables as files: rows of a key together in a bucket, months apart.

Two tables bucketed alike are joined, and one is grouped, by the bucket column without
moving a row.  A bucket is one task's work, so a table in which a single key holds more
rows than a task should see is written without buckets, in files of even size, and its
joins go the salted way (operators/skew.py).

A table that builds renew month by month has a folder for each month.  One that is made
once and only read has its buckets sorted by the bucket column; route numbers begin with
the month, so a reader of few months skips the other pages by their statistics, and there
are no more files than buckets.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from drayage import schemas

BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8
MOST_BUCKETS = 8192
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def bucket_count(spark: SparkSession, source_bytes: int, folders: bool) -> int:
    """Buckets for tables made from so many bytes (spark.drayage.buckets overrides).

    With a folder for each month, a small table has one, for the sake of its files.
    """
    set_by_hand = spark.conf.get("spark.drayage.buckets", None)
    if set_by_hand:
        return int(set_by_hand)
    buckets = 1 if folders else LEAST_BUCKETS
    while buckets * BUCKET_BYTES < source_bytes and buckets < MOST_BUCKETS:
        buckets *= 2
    return buckets


def arranged(df: DataFrame, table: str, buckets: int | None, placed: bool, folders: bool = True) -> DataFrame:
    """df dealt out so that each bucket of a month, or each even part of one, is one file.

    ``placed`` says that the rows already lie in the tasks that should write them.
    """
    partition, bucket = schemas.PARTITION_COLUMNS[table], schemas.BUCKET_COLUMNS.get(table)
    if bucket and buckets == 1 and partition and folders:
        return df.repartition(partition)  # a file a month, written side by side
    if placed:
        return df
    if bucket and buckets:
        return df.repartition(buckets, bucket)
    # the hint splits months that are large and merges those that are small
    return df.hint("rebalance", partition) if partition else df


def write_table(
    df: DataFrame,
    name: str,
    table: str,
    buckets: int | None = None,
    placed: bool = False,
    path: str | None = None,
    folders: bool = True,
) -> DataFrame:
    """Write df as the new catalog table ``name``, laid out as ``table`` is; its files go to ``path`` if given.

    Without ``folders``, months of a bucketed table are told apart by order alone.
    """
    out = arranged(df, table, buckets, placed, folders).write.format("parquet")
    partition, bucket = schemas.PARTITION_COLUMNS[table], schemas.BUCKET_COLUMNS.get(table)
    if bucket and buckets:
        out = out.bucketBy(buckets, bucket)
        if not folders:
            out = out.sortBy(bucket)
    if partition and (folders or (bucket and not buckets)):
        out = out.partitionBy(partition)
    if path:
        out = out.option("path", path)
    out.saveAsTable(name)
    return df.sparkSession.table(name)


def replace_months(df: DataFrame, name: str, table: str, months: set[str], buckets: int | None, placed: bool = False) -> None:
    """Put df, rows of the given months, in place of all rows that table ``name`` has of them.

    Other months are not touched.  A month that df has no rows of is dropped.
    """
    spark, partition = df.sparkSession, schemas.PARTITION_COLUMNS[table]
    left = {r[0] for r in df.select(partition).distinct().collect()}
    rows = arranged(df, table, buckets, placed)
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(OVERWRITE_MODE, before)
    for month in sorted(months - left):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({partition} = '{month}')")


def of_months(df: DataFrame, table: str, months: set[str]) -> DataFrame:
    """The rows of the given months; other months are not read."""
    return df.where(F.col(schemas.PARTITION_COLUMNS[table]).isin(sorted(months)))

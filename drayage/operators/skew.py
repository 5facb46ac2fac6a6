"""Finding keys that hold more rows than one task should see.

The answer only decides which of two exact ways a row takes.  A Misra-Gries summary,
kept by every task and merged, names each key above a share of the rows (and some that
are not); the named ones are counted exactly.  For small frames a sample does.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drayage.sources.staging import stage

HOT_ROWS = 5_000_000
SAMPLED_ROWS = 1_000
MAX_BROADCAST_ROWS = 1_000_000
#: A key with less than this share of the rows is no more than a usual partition.
LEAST_SHARE = 1e-4


def hot_row_limit(spark: SparkSession) -> int:
    """Rows of one key a single task may hold (spark.drayage.hotRows)."""
    return int(spark.conf.get("spark.drayage.hotRows", str(HOT_ROWS)))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its known row count is small; else leave it to Spark."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


class HotKeys:
    """Keys above the limit with their row counts; at most all rows / limit keys."""

    def __init__(self, table: DataFrame, keys: list[str], limit: int, rows: int | None = None):
        self.keys, self.limit = keys, limit
        self.table = bounded(table, table.count() if rows is None else rows)

    def renamed(self) -> DataFrame:
        return self.table.select(*[F.col(k).alias(f"hot_{k}") for k in self.keys], "hot_count")

    def matches(self, df: DataFrame) -> Column:
        """Join condition of df against renamed(); missing keys match too."""
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & df[k].eqNullSafe(F.col(f"hot_{k}"))
        return condition


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys | None:
    """One pass over the key columns; None when no key is hot."""
    limit = limit or hot_row_limit(df.sparkSession)
    rows = df.select(*keys)
    fraction = min(1.0, SAMPLED_ROWS / limit)
    if fraction < 1.0:
        rows = rows.sample(fraction, seed=7)
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(fraction)).cast("long").alias("hot_count"))
    counts = counts.where(F.col("hot_count") > limit)
    found = counts.count()
    return HotKeys(stage(counts, "hot-keys"), list(keys), limit, found) if found else None


def heavy_hitters(df: DataFrame, keys: list[str], limit: int | None = None) -> dict[str, list[tuple[int | None, int]]]:
    """For each column of whole numbers its keys above the limit, with exact counts.

    One pass merges a Misra-Gries summary of each column (``freqItems`` keeps one per
    task); the keys that it names, at most rows / limit and 1 / LEAST_SHARE of them, are
    then counted.  A table with no more rows than the limit has none and is not read.
    """
    limit = limit or hot_row_limit(df.sparkSession)
    rows = df.count()
    if rows <= limit:
        return {k: [] for k in keys}
    known = df.select(*[F.col(k).cast("long").alias(k) for k in keys])
    summary = known.stat.freqItems(keys, max(limit / rows, LEAST_SHARE)).first()
    found = {}
    for k, named in zip(keys, summary):
        wanted = F.col(k).isNull()
        if named:
            wanted = wanted | F.col(k).isin([n for n in named if n is not None])
        counts = known.where(wanted).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
        found[k] = [(r[0], r[1]) for r in counts.collect()]
    return found


def hot_keys_of(spark: SparkSession, key: str, listed: list[tuple[int | None, int]]) -> HotKeys | None:
    """Hot keys that are already known; starts no job."""
    if not listed:
        return None
    table = spark.createDataFrame(listed, f"{key} long, hot_count long")
    return HotKeys(table, [key], hot_row_limit(spark), len(listed))

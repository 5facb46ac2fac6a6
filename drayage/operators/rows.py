"""Steps that keep, repeat or lay out rows; none of them needs to see a group."""

from pyspark.sql import Column, DataFrame, functions as F

from drayage.functions.draws import hash_bucket

EXPAND_STEP = 1_000


def sample_by_rate(df: DataFrame, keys, rate: Column, salt: str = "filter") -> DataFrame:
    """Keep each row with its own probability; the same rows every time."""
    return df.where(hash_bucket(keys, salt, 1000) / F.lit(1000.0) < rate.cast("double"))


def date_spine(bounds: DataFrame, start: str, end: str, name: str = "day") -> DataFrame:
    """One row per day between the two date columns, both included."""
    days = F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))
    return bounds.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(days))


def grid(df: DataFrame, **axes) -> DataFrame:
    """Every row of df with every combination of the literal axis values.

    The axes are short lists given by the caller, so each row is repeated a
    fixed number of times and nothing is shuffled.
    """
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def expand_rows(df: DataFrame, count_col: str, name: str = "sequence", spread: bool = True) -> DataFrame:
    """One row per unit, numbered from 1; counts below 1 or missing give none.

    Counts are cut into runs first and the runs are spread over the tasks, so a
    single huge count neither builds one huge array nor stays in one task.
    """
    count = F.col(count_col).cast("long")
    step = F.greatest(F.lit(EXPAND_STEP), F.ceil(F.sqrt(count)).cast("long"))
    runs = df.where(count >= 1).withColumn("__step", step)
    runs = runs.withColumn(
        "__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count_col).cast("long"), F.col("__step")))
    )
    if spread:
        runs = runs.repartition(*[F.col(c) for c in df.columns], F.col("__from"))
    last = F.least(F.col(count_col).cast("long"), F.col("__from") + F.col("__step") - 1)
    return runs.withColumn(name, F.explode(F.sequence(F.col("__from"), last))).drop("__from", "__step")

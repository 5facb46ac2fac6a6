"""Small dimensions: vehicle classes and depots."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from drayage import fixed_values as fv
from drayage.schemas import DEPOTS, STRING, INT, conform


def _inline(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """Literal rows; at most a handful, hence always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def vehicle_types(spark: SparkSession) -> DataFrame:
    money = T.DecimalType(8, 2)
    schema = T.StructType(
        [
            T.StructField("type_no", INT),
            T.StructField("vehicle_type", STRING),
            T.StructField("base_weight_lbs", INT),
            T.StructField("base_volume_cuft", INT),
            T.StructField("max_stops_per_route", INT),
            T.StructField("usual_fuel", STRING),
            T.StructField("base_cost_per_mile", money),
            T.StructField("base_daily_cost", money),
        ]
    )
    return _inline(spark, [(i, *row) for i, row in enumerate(fv.VEHICLE_TYPES)], schema)


def depots(nation: DataFrame, region: DataFrame) -> DataFrame:
    """One depot per nation; position and demand class follow from its key."""
    key = F.col("n_nationkey")
    place = key % 8
    table = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        F.concat(F.lit("DEPOT_"), "n_name").alias("depot_id"),
        F.col("n_name").alias("name"),
        ((key * 7) % 24 + 25).cast("double").alias("lat"),
        ((key * 11) % 50 - 120).cast("double").alias("lon"),
        F.col("r_name").alias("service_region"),
        F.when(place < 3, "busy").when(place < 5, "regular").otherwise("small").alias("depot_class"),
    )
    return table


def depot_table(depots_by_nation: DataFrame) -> DataFrame:
    return conform(depots_by_nation, DEPOTS)

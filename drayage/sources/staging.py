"""Intermediate tables in the folder all executors share.

Written tables cut the lineage: what is staged survives the loss of the
executors that computed it.  The folder is the cluster's spark.checkpoint.dir;
only a local master, as in tests, may fall back to a temporary folder.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="drayage-")
    return _local_dirs[app]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once and return a reader of the written rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/drayage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder named by spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in if the master is local; on a cluster a
    folder of the driver would be out of reach for executors, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="furlong-")
    return f"{base.rstrip('/')}/furlong-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """The number of a shuffle's partitions; a repartition by it is not coalesced, so tasks whose rows grow after the shuffle stay small."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The file sizes become the plan's statistics, so estimates don't grow in loops, and Spark
    may remove the shuffle files of the write at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Empty tables of `written` that no later step reads."""
    for df in frames:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(files[0].rpartition("/")[0])

"""Incremental forms of ingest; each has a batch operator as its oracle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import scd2_append


def stream_scd2(source: DataFrame, path: str, checkpoint: str, keys: list[str], payload: list[str], order: str) -> StreamingQuery:
    """Merge each micro-batch into the table of versions below `path`; a batch id that repeats overwrites itself.

    Versions of batch n lie in path/v=n, a whole table each; readers take the largest n.
    """
    spark = source.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        current = spark.read.parquet(f"{path}/v={n - 1}") if n else None
        scd2_append(current, batch, keys, payload, order).write.mode("overwrite").parquet(f"{path}/v={n}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(source: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Newest row per key; repeats within the watermark count once. For update or complete mode."""
    rows = source.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, "event_id"])
    return rows.groupBy(*keys).agg(F.max(F.struct(ts, "event_id", "value")).alias("r")).select(*keys, "r.*")


def stream_daily_counts(source: DataFrame, ts: str, status: str, delay: str = "1 day") -> DataFrame:
    """Events per day and status; rows later than the watermark are dropped."""
    return source.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), status).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), status, "n")


def stream_table(result: DataFrame, path: str) -> DataFrame:
    """Run a stream over all that is there, in complete mode, and return its table from the last batch's Parquet files.

    Batch n writes the whole result to path/v=n; the checkpoint lies in path/checkpoint.
    """
    done: list[int] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={n}")
        done.append(n)

    result.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = result.sparkSession
    return spark.read.schema(result.schema).parquet(f"{path}/v={max(done)}") if done else spark.createDataFrame([], result.schema)

"""Helpers that the corpus operators share."""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import forget, shared_folder, written

__all__ = ["SPACE", "forget", "id_and_text", "let", "partitions", "read", "released", "shared_folder", "sliced", "trim", "written"]

#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text reads as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; expressions in lambdas are computed at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim() -> None:
    """Give memory that Arrow and numpy have freed back to the system; else the process keeps it for good."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it, other libraries may not
        give(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of mapInArrow that gives unused memory back at the end of a task; Python workers live on between stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def sliced(batches: Iterator, size: int = 2_000_000) -> Iterator:
    """The same rows in batches of about so many bytes, which bounds what Python makes of them at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, size))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

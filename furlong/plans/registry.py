"""Pipelines by name: functions from tables to a DataFrame, run with parameters and counted on the way."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

PIPELINES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        PIPELINES[name] = f
        return f

    return add


def run(name: str, tables: dict[str, DataFrame], **params) -> tuple[DataFrame, Observation]:
    """The pipeline's result, and an observation that has its row count once an action has run."""
    if name not in PIPELINES:
        raise KeyError(f"no pipeline {name!r}; there are {sorted(PIPELINES)}")
    seen = Observation(name)
    return PIPELINES[name](tables, **params).observe(seen, F.count(F.lit(1)).alias("rows")), seen

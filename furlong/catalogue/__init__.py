"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from . import asof, audit, checks, ingest, prerace, scalars, scoring, starts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (scalars, starts, ingest, scoring, prerace, asof, audit, checks):
    QUERIES |= module.QUERIES
    SQL |= module.SQL

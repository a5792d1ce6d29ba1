"""Where queries are registered, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .testbed import BASE, Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = (BASE if base else "") + sql
        return f

    return add


def cut6(c) -> F.Column:
    return geo.round_half_up(F.col(c) if isinstance(c, str) else c, 6)


def sql6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


us = lambda c: F.unix_micros(c)

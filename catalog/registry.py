"""Registry of queries and the SQL each must agree with.

An output spec such as ``"ticker:s ts:d ret:f n:i up:b"`` fixes column names and printable forms on both sides:
``s`` text, ``d`` date as text, ``t`` timestamp as text, ``i`` bigint, ``b`` boolean, ``f`` double kept to six
decimals (``f0`` to ``f9`` for another number).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazily opened parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in spec.split()]


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "s":
        out = c.cast("string")
    elif kind == "d":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind == "t":
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "i":
        out = c.cast("long")
    elif kind == "b":
        out = c.cast("boolean")
    else:
        scale = 10.0 ** int(kind[1:] or 6)
        value = c.cast("double")
        out = F.floor(F.when(~F.isnan(value), value) * scale + 0.5) / scale
    return out.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "d":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    scale = f"1e{int(kind[1:] or 6)}"
    return f"floor(CAST({name} AS DOUBLE) * {scale} + 0.5) / {scale} AS {name}"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under ``name``."""

    def add(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder)).select(*[_spark_column(n, k) for n, k in _fields(spec)])

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            columns = ", ".join(_sql_column(n, k) for n, k in _fields(spec))
            ORACLES[name] = f"SELECT {columns} FROM ({sql}) AS answer"
        return function

    return add

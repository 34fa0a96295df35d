"""Registry of named queries over the test tables, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerscope.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _whole_numbers_as_long(df: DataFrame) -> DataFrame:
    kinds = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None):
    """Register a function of Tables; integer results are widened so that both engines agree on types."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _whole_numbers_as_long(build(Tables(spark, folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def joined(column: Column | str, separator: str = "|") -> Column:
    """An array shown as text."""
    array = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(array, lambda x: x.cast("string")), separator)

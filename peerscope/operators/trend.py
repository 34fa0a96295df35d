"""Recent trend over an entity's own years.

An entity-year table has one row per entity and year, so a per-entity window holds as many rows as
there are reporting years, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.stats import linear_slope
from peerscope.functions.units import PANDEMIC_YEARS

MIN_YEARS = 3
MAX_YEARS = 5


def _valid(year: Column, value: Column, usable: Column | None) -> Column:
    good = (value > 0) & (F.abs(value) < float("inf"))
    if usable is not None:
        good = good & usable
    return F.when(good, F.struct(year.cast("int").alias("x"), value.alias("y")))


def trend_columns(
    df: DataFrame, points: str, prefix: str, minimum: int, maximum: int, pandemic_years: Sequence[int]
) -> DataFrame:
    """Add <prefix>pct, <prefix>years and <prefix>excluded from an array of (x, y) points by year."""
    kept, used = f"_{prefix}kept", f"_{prefix}used"
    df = df.withColumn(kept, F.filter(points, lambda p: ~p["x"].isin(*pandemic_years)))
    df = df.withColumn(used, F.slice(kept, F.greatest(F.size(kept) - (maximum - 1), F.lit(1)), F.lit(maximum)))
    mean = F.try_divide(F.aggregate(F.col(used), F.lit(0.0), lambda a, p: a + p["y"]), F.size(used))
    df = df.withColumn(f"{prefix}pct", F.when(F.size(used) >= minimum, linear_slope(F.col(used)) / mean * 100))
    known = F.col(f"{prefix}pct").isNotNull()
    none = F.array().cast("array<int>")
    first = F.try_element_at(F.col(used), F.lit(1))["x"]
    excluded = F.filter(points, lambda p: p["x"].isin(*pandemic_years) & (p["x"] >= first))
    return (
        df.withColumn(f"{prefix}years", F.when(known, F.transform(used, lambda p: p["x"])).otherwise(none))
        .withColumn(f"{prefix}excluded", F.when(known, F.transform(excluded, lambda p: p["x"])).otherwise(none))
        .drop(kept, used)
    )


def trend_as_known(
    df: DataFrame,
    entity: str,
    year: str,
    value: str,
    usable: Column | None = None,
    prefix: str = "trend_",
    minimum: int = MIN_YEARS,
    maximum: int = MAX_YEARS,
    pandemic_years: Sequence[int] = PANDEMIC_YEARS,
) -> DataFrame:
    """Trend at every row from that row's year and the years before it."""
    past = Window.partitionBy(entity).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_points", F.collect_list(_valid(F.col(year), F.col(value), usable)).over(past))
    return trend_columns(df, "_points", prefix, minimum, maximum, pandemic_years).drop("_points")


def trend_per_entity(
    df: DataFrame,
    entity: str,
    year: str = "year",
    value: str = "value",
    windows: Sequence[tuple[str, int, int]] = (("trend_", MIN_YEARS, MAX_YEARS),),
    pandemic_years: Sequence[int] = PANDEMIC_YEARS,
) -> DataFrame:
    """One row per entity with one trend per (prefix, minimum, maximum)."""
    points = F.array_sort(F.collect_list(_valid(F.col(year), F.col(value), None)))
    result = df.groupBy(entity).agg(points.alias("_points"))
    for prefix, minimum, maximum in windows:
        result = trend_columns(result, "_points", prefix, minimum, maximum, pandemic_years)
    return result.drop("_points")

"""First-wins dedupe, latest attributes, entity-years, yearly series and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.text import operation_category
from peerscope.functions.units import PANDEMIC_YEARS, per_area

SUMMED = ("total_site_energy_gj", "floor_area_m2", "ghg_kg_co2e", "electricity_kwh")
DERIVED_TOTAL = "total_energy_derived_from_reported_intensity"


def sum_all(value: str | Column) -> Column:
    """Sum that is NULL as soon as one part is NULL."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key plus ``copies``, the number of rows it stands for.

    min_by combines on the map side and keeps one row per key, so a hot key costs nothing extra.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("copies")
    )
    return picked.select(*keys, "_row.*", "copies").select(*df.columns, "copies")


def dedupe_facility_years(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flags: str = "data_quality_flags"
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the first row per key is kept and flagged when others were dropped.

    ``order`` must identify a row within its key.
    """
    kept = first_per_key(df, keys, order)
    marked = F.when(
        F.col("copies") > 1, F.array_union(F.col(flags), F.array(F.lit("duplicate_facility_year")))
    ).otherwise(F.col(flags))
    position = F.struct(*order)
    later = (
        kept.filter("copies > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], position.alias("_first"))
    )
    same = F.lit(True)
    for key in keys:
        same = same & df[key].eqNullSafe(later[f"_{key}"])
    rejected = df.join(later, same & (position != later["_first"])).select(*df.columns)
    return (
        kept.withColumn(flags, marked).drop("copies"),
        rejected.withColumn("reject_reason", F.lit("duplicate_facility_year")),
    )


def latest_attributes(df: DataFrame, key: str, year: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Descriptive columns from each key's most recent year, plus ``latest_year``."""
    newest = F.max_by(F.struct(*columns), F.struct(year, *tie))
    return df.groupBy(key).agg(newest.alias("_row"), F.max(year).alias("latest_year")).select(key, "_row.*", "latest_year")


def combine_entity_years(records: DataFrame) -> DataFrame:
    """One row per entity (school, or facility without one) and reporting year.

    The member with the largest floor area describes the entity (ties: lowest facility key). Sums
    and the match confidence need every part; hours survive only for a single member. Flag sets are
    small and shared by many rows, so collect_set holds a bounded number of distinct sets.
    """
    entity = F.when(F.col("school_id").isNotNull(), F.concat(F.lit("s"), F.col("school_id"))).otherwise(
        F.concat(F.lit("f"), F.col("facility_id"))
    )
    largest = F.max_by(
        F.struct("school_id", "facility_id", "operation_type", "school_level", "weekly_hours"),
        F.struct(F.coalesce("floor_area_m2", F.lit(0.0)), -F.col("facility_id")),
    )
    grouped = (
        records.withColumn("entity_key", entity)
        .groupBy("entity_key", "reporting_year")
        .agg(
            largest.alias("_main"),
            F.count("*").alias("facility_count"),
            F.when(F.count("match_confidence") == F.count("*"), F.min("match_confidence")).alias("match_confidence"),
            *[sum_all(c).alias(c) for c in SUMMED],
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))).alias("_flags"),
        )
    )
    combined = F.array_union("_flags", F.array(F.lit("multiple_facilities_combined")))
    return grouped.select(
        "entity_key",
        F.col("_main.school_id").alias("school_id"),
        F.when(F.col("_main.school_id").isNull(), F.col("_main.facility_id")).alias("facility_id"),
        "reporting_year",
        "facility_count",
        operation_category(F.col("_main.operation_type")).alias("operation_category"),
        F.col("_main.school_level").alias("school_level"),
        "match_confidence",
        *SUMMED,
        F.when(F.col("facility_count") == 1, F.col("_main.weekly_hours")).alias("weekly_hours"),
        F.when(F.col("facility_count") > 1, combined).otherwise(F.col("_flags")).alias("quality_flags"),
        per_area(F.col("total_site_energy_gj"), F.col("floor_area_m2")).alias("eui"),
        per_area(F.col("ghg_kg_co2e"), F.col("floor_area_m2")).alias("ghg_intensity"),
        per_area(F.col("electricity_kwh"), F.col("floor_area_m2")).alias("electricity_intensity"),
    )


def combine_yearly(records: DataFrame, key: str = "school_id", pandemic_years: Sequence[int] = PANDEMIC_YEARS) -> DataFrame:
    """Yearly series per key over every matched facility, with the all-or-nothing sums."""
    first = F.min_by(F.struct("reporting_period_end", "operation_type"), F.col("facility_id"))
    one = F.count("*") == 1
    sums = (
        "total_site_energy_gj",
        "normalized_total_energy_gj",
        "electricity_kwh",
        "natural_gas_gj",
        "natural_gas_m3",
        "ghg_kg_co2e",
        "floor_area_m2",
    )
    grouped = records.groupBy(key, F.col("reporting_year").alias("year")).agg(
        first.alias("_first"),
        F.count("*").alias("facility_count"),
        *[sum_all(c).alias(c) for c in sums],
        F.when(one, F.max("weekly_hours")).alias("weekly_hours"),
        F.when(one, F.max("portable_count")).alias("portable_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("data_quality_flags")))).alias("quality_flags"),
        F.array_sort(F.collect_set("source_resource")).alias("sources"),
    )
    return grouped.select(
        key,
        "year",
        F.col("_first.reporting_period_end").alias("period_end"),
        "facility_count",
        *sums,
        "weekly_hours",
        "portable_count",
        F.col("_first.operation_type").alias("operation_type"),
        per_area(F.col("total_site_energy_gj"), F.col("floor_area_m2")).alias("eui"),
        per_area(F.col("ghg_kg_co2e"), F.col("floor_area_m2")).alias("ghg_intensity"),
        per_area(F.col("electricity_kwh"), F.col("floor_area_m2")).alias("electricity_intensity"),
        F.array_contains("quality_flags", DERIVED_TOTAL).alias("total_derived"),
        F.col("year").isin(*pandemic_years).alias("pandemic_affected"),
        "quality_flags",
        "sources",
    )


def with_year_gaps(series: DataFrame, key: str | None, year: str = "year") -> DataFrame:
    """A row for every year between a key's first and last; years without data have ``missing``."""
    keys = [key] if key else []
    span = series.groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(year))
    marked = series.withColumn("_present", F.lit(True))
    return (
        grid.join(marked, [*keys, year], "left")
        .withColumn("missing", F.col("_present").isNull())
        .drop("_present")
    )


def year_over_year(
    series: DataFrame, key: str, year: str = "year", value: str = "value", pandemic_years: Sequence[int] = PANDEMIC_YEARS
) -> DataFrame:
    """Changes between consecutive years; a gap is never bridged. A key's series is one row a year."""
    order = Window.partitionBy(key).orderBy(year)
    rows = (
        series.filter(F.col(value) > 0)
        .withColumn("previous_year", F.lag(year).over(order))
        .withColumn("_before", F.lag(value).over(order))
        .filter(F.col(year) == F.col("previous_year") + 1)
    )
    change = (F.col(value) - F.col("_before")) / F.col("_before")
    return rows.select(
        key,
        F.col(year).alias("year"),
        "previous_year",
        (change * 100).alias("change_pct"),
        (F.abs(change) > 0.3).alias("large"),
        (F.col(year).isin(*pandemic_years) | F.col("previous_year").isin(*pandemic_years)).alias("pandemic_affected"),
    )

"""Display formatting for report exports; stored values keep full precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerscope.functions.units import finite

# --- fixed values: signs and labels ---------------------------------------------------------------
MISSING = "—"
MINUS = "−"
LEVEL_LABELS = {
    "elementary": "Elementary school",
    "secondary": "Secondary school",
    "combined": "Elementary and secondary school",
}


def _shown(value: Column, text: Column) -> Column:
    return F.when(finite(value).isNotNull(), text).otherwise(MISSING)


def _round_away(value: Column, digits: int) -> Column:
    # decimal text of the double rounds half away from zero, as number formatters do
    return F.round(value.cast("decimal(38,12)"), digits)


def number(value: Column, digits: int = 0) -> Column:
    """Thousands separators, fixed digits, a true minus sign."""
    text = F.format_number(_round_away(F.abs(value.cast("double")), digits), digits)
    sign = F.when(value < 0, MINUS).otherwise("")
    return _shown(value.cast("double"), F.concat(sign, text))


def _adaptive(value: Column) -> Column:
    return F.when(F.abs(value) < 100, number(value, 1)).otherwise(number(value, 0))


def _with_unit(value: Column, text: Column, unit: str) -> Column:
    return _shown(value, F.concat(text, F.lit(f" {unit}")))


def gj(value: Column) -> Column:
    return _with_unit(value, _adaptive(value), "GJ")


def eui(value: Column) -> Column:
    return _with_unit(value, number(value, 2), "GJ/m²")


def ekwh_per_m2(value: Column) -> Column:
    return _with_unit(value, number(value), "ekWh/m²")


def kwh_per_m2(value: Column) -> Column:
    return _with_unit(value, number(value), "kWh/m²")


def kwh(value: Column) -> Column:
    return _with_unit(value, number(value), "kWh")


def ghg_intensity(value: Column) -> Column:
    return _with_unit(value, number(value, 1), "kg CO₂e/m²")


def tonnes_co2e(kg: Column) -> Column:
    return _with_unit(kg, _adaptive(kg / 1000), "t CO₂e")


def area(value: Column) -> Column:
    return _with_unit(value, number(value), "m²")


def split_unit(formatted: Column) -> Column:
    """STRUCT(value, unit) of "1,240 GJ"."""
    pattern = r"^([+−-]?[\d,.]+)\s+(.+)$"
    hit = formatted.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(formatted, pattern, 1)).otherwise(formatted).alias("value"),
        F.when(hit, F.regexp_extract(formatted, pattern, 2)).otherwise("").alias("unit"),
    )


def ordinal(value: Column) -> Column:
    n = F.floor(value + 0.5).cast("long")
    ending = (
        F.when((n % 100).between(11, 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), ending)


def percentile(value: Column) -> Column:
    return _shown(value, F.concat(ordinal(value), F.lit(" percentile")))


def signed_percent(value: Column, digits: int = 1) -> Column:
    rounded = _round_away(value, digits)
    sign = F.when(rounded > 0, "+").when(rounded < 0, MINUS).otherwise("")
    return _shown(value, F.concat(sign, F.format_number(F.abs(rounded), digits), F.lit("%")))


def year_range(years: Column) -> Column:
    first, last = F.array_min(years), F.array_max(years)
    return (
        F.when(F.size(years) == 0, MISSING)
        .when(first == last, first.cast("string"))
        .otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))
    )


def school_level(level: Column) -> Column:
    label = level
    for key, text in LEVEL_LABELS.items():
        label = F.when(level == key, text).otherwise(label)
    return F.coalesce(label, F.lit("School level not reported"))

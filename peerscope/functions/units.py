"""Numbers, units, intensities and quality flags as Column expressions.

A value is NULL whenever its inputs cannot support it; nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerscope.functions.text import let, normalize_header

# --- fixed values: exact conversions and unit labels ----------------------------------------------
GJ_PER_KWH = 0.0036
KWH_PER_GJ = 1000 / 3.6
KG_PER_TONNE = 1000.0
ELECTRICITY_TO_KWH = {"kwh": 1.0, "kilowatt hours": 1.0, "mwh": 1000.0, "megawatt hours": 1000.0}
GAS_TO_M3 = {
    "m3": 1.0,
    "cubic meter": 1.0,
    "cubic meters": 1.0,
    "cubic metre": 1.0,
    "cubic metres": 1.0,
    "metre cube": 1.0,
    "metres cubes": 1.0,
}
GAS_IN_GJ = ("giga joule", "gigajoule", "gigajoules", "gj")
AREA_TO_M2 = {
    "square feet": 0.09290304,
    "sq ft": 0.09290304,
    "ft2": 0.09290304,
    "pieds carres": 0.09290304,
    "square meters": 1.0,
    "square metres": 1.0,
    "sq m": 1.0,
    "m2": 1.0,
    "metres carres": 1.0,
}
# --- fixed values: plausibility bounds, bounding box, disrupted years -----------------------------
EUI_PLAUSIBLE = (0.05, 5.0)
GHG_PLAUSIBLE_MAX = 500.0
LATITUDE_RANGE = (41.5, 57.0)
LONGITUDE_RANGE = (-95.5, -74.0)
PANDEMIC_YEARS = (2020, 2021)
ENERGY_FIELDS = (
    "electricity_kwh",
    "electricity_gj",
    "natural_gas_m3",
    "natural_gas_gj",
    "fuel_oil_gj",
    "other_energy_gj",
    "total_site_energy_gj",
    "normalized_total_energy_gj",
)

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(value) < float("inf"), value)


def to_float(value: Column) -> Column:
    """Parse "1,234.5", "$1,234"; text, blanks and non-finite numbers become NULL."""
    text = F.regexp_replace(value.cast("string"), r"(?U)[,\s$]", "")
    return let(F.when(text.rlike(_NUMBER), text).try_cast("double"), finite)


def unit_factor(unit: Column, factors: Mapping[str, float]) -> Column:
    """The factor of a unit's label; NULL if it is unknown. Usual labels are keys as they stand and skip the normalisation."""
    table = F.create_map(*[F.lit(part) for pair in factors.items() for part in pair])
    return F.coalesce(F.try_element_at(table, F.lower(unit)), F.try_element_at(table, normalize_header(unit)))


def convert_quantity(quantity: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """STRUCT(value, recognized). Zero needs no unit; an unknown unit gives (NULL, false)."""

    def converted(q: Column) -> Column:
        amount, factor = q["amount"], q["factor"]
        return F.struct(
            F.when(amount == 0, F.lit(0.0)).otherwise(amount * factor).alias("value"),
            (amount.isNull() | (amount == 0) | factor.isNotNull()).alias("recognized"),
        )

    return let(F.struct(to_float(quantity).alias("amount"), unit_factor(unit, factors).alias("factor")), converted)


def gas_quantities(reported_gj: Column, quantity: Column, unit: Column) -> Column:
    """STRUCT(m3, gj, recognized): gas is GJ only as reported, never converted from volume."""
    table = F.create_map(*[F.lit(part) for pair in GAS_TO_M3.items() for part in pair])

    def measured(q: Column) -> Column:
        applies = q["gj"].isNull() & q["amount"].isNotNull()
        volume = (q["amount"] == 0) | q["unit"].isin(*GAS_TO_M3)
        factor = F.coalesce(F.try_element_at(table, q["unit"]), F.lit(1.0))
        in_gj = q["unit"].isin(*GAS_IN_GJ)
        return F.struct(
            F.when(applies & volume, q["amount"] * factor).alias("m3"),
            F.when(applies & ~volume & in_gj, q["amount"]).otherwise(q["gj"]).alias("gj"),
            (~applies | volume | in_gj).alias("recognized"),
        )

    cell = F.struct(reported_gj.alias("gj"), to_float(quantity).alias("amount"), normalize_header(unit).alias("unit"))
    return let(cell, measured)


def reported_sum(parts: Sequence[Column]) -> Column:
    """Sum of the parts that are present; NULL when none is."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(F.coalesce(*parts).isNotNull(), total)


def slot_value(slots: Sequence[tuple[Column, Column]], label: str) -> Column:
    """Value of the first name/value slot whose normalised name equals the label and parses."""
    options = F.array(*[F.struct(normalize_header(n).alias("n"), to_float(v).alias("v")) for n, v in slots])
    return F.try_element_at(F.filter(options, lambda s: (s["n"] == label) & s["v"].isNotNull()), F.lit(1))["v"]


def whole_number(value: Column) -> Column:
    return F.when((value == F.floor(value)) & (F.abs(value) < 2**31), value.cast("int"))


def per_area(quantity: Column, area: Column) -> Column:
    """quantity / area for a non-negative quantity and a positive area, else NULL."""
    return F.when((finite(quantity) >= 0) & (finite(area) > 0), quantity / area)


def kwh_equivalent(gj: Column) -> Column:
    return finite(gj) * F.lit(KWH_PER_GJ)


def gap_to_median(eui: Column, median: Column, area: Column) -> Column:
    """max(0, eui - median) x area, NULL when an input is missing or the area is not positive."""
    known = eui.isNotNull() & median.isNotNull() & (area > 0)
    return F.when(known, F.greatest(F.lit(0.0), eui - median) * area)


def coordinates(latitude: Column, longitude: Column) -> Column:
    """STRUCT(latitude, longitude) when both parse and lie in the bounding box, else NULL."""
    lat, lon = to_float(latitude), to_float(longitude)
    inside = lat.between(*LATITUDE_RANGE) & lon.between(*LONGITUDE_RANGE)
    return F.when(inside, F.struct(lat.alias("latitude"), lon.alias("longitude")))


def trend_factor(annual_pct: Column) -> Column:
    """-10 %/yr or better is 0, +10 %/yr or worse is 1, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (annual_pct + 10) / 20))


def quality_flags(
    value: Callable[[str], Column],
    year: Column,
    eui_range: tuple[float, float] = EUI_PLAUSIBLE,
    ghg_max: float = GHG_PLAUSIBLE_MAX,
    pandemic_years: Sequence[int] = PANDEMIC_YEARS,
    energy_fields: Sequence[str] = ENERGY_FIELDS,
) -> Column:
    """Ordered ARRAY of record-level flags. ``value`` maps a measure name to its Column."""
    area, total, ghg = value("floor_area_m2"), value("total_site_energy_gj"), value("ghg_kg_co2e")
    negative = F.lit(False)
    for field in energy_fields:
        negative = negative | F.coalesce(value(field) < 0, F.lit(False))
    measured = F.coalesce(area > 0, F.lit(False))
    odd_eui = F.coalesce(~(F.try_divide(total, area).between(*eui_range)), F.lit(False))
    odd_ghg = F.coalesce(F.try_divide(ghg, area) > ghg_max, F.lit(False))
    zero_total = (total == 0) & (F.coalesce(value("electricity_kwh"), F.lit(0.0)) > 0)
    return F.array_compact(
        F.array(
            F.when(area.isNull(), F.lit("missing_floor_area")).when(area <= 0, F.lit("nonpositive_floor_area")),
            F.when(total.isNull(), F.lit("missing_total_energy")).when(
                zero_total, F.lit("zero_total_with_reported_consumption")
            ),
            F.when(negative, F.lit("negative_energy_value")),
            F.when(measured & (odd_eui | odd_ghg), F.lit("implausible_intensity")),
            F.when(year.isin(*pandemic_years), F.lit("pandemic_affected_period")),
        )
    )


def plausible(flags: Column) -> Column:
    return ~F.array_contains(flags, "implausible_intensity")


# --- fixed values: flags that exclude a record from peer groups, and those that block a score -----
PEER_EXCLUSIONS = (
    "implausible_intensity",
    "negative_energy_value",
    "duplicate_facility_year",
    "nonpositive_floor_area",
    "zero_total_with_reported_consumption",
)
SCORE_BLOCKERS = (
    "implausible_intensity",
    "negative_energy_value",
    "duplicate_facility_year",
    "nonpositive_floor_area",
)


def usable_as_peer(flags: Column) -> Column:
    return ~F.exists(flags, lambda f: f.isin(*PEER_EXCLUSIONS) | f.startswith("unrecognized_unit"))


def blocking_flags(flags: Column) -> Column:
    return F.filter(flags, lambda f: f.isin(*SCORE_BLOCKERS) | f.startswith("unrecognized_unit"))

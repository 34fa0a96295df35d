"""Opportunity score and data-confidence rating as Column expressions with ordered reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerscope.functions.units import blocking_flags, trend_factor


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def opportunity_score(
    percentile: Column, peer_count: Column, trend_pct: Column, trend_years: Column, confidence: Column, flags: Column
) -> Column:
    """STRUCT(suppressed, score, confidence, used_trend, reasons).

    100 x (0.8 P + 0.2 trend factor), P alone without a trend; suppressed without ten peers or with
    a flag that makes the numbers doubtful.
    """
    short = percentile.isNull() | (peer_count < 10)
    blocking = blocking_flags(flags)
    blocked = F.size(blocking) > 0
    used = trend_pct.isNotNull()
    share = percentile / 100
    raw = F.when(used, share * 0.8 + trend_factor(trend_pct) * 0.2).otherwise(share)
    confirmed = F.coalesce(confidence >= 0.95, F.lit(False))
    incomplete = F.array_contains(flags, "missing_total_energy") | F.array_contains(flags, "missing_floor_area")
    points = (
        F.when(peer_count >= 20, 2).otherwise(1)
        + F.when(used, 2).otherwise(0)
        + F.when(confirmed, 1).otherwise(0)
        - F.when(incomplete, 1).otherwise(0)
    )
    count = peer_count.cast("string")
    reasons = _texts(
        F.when(peer_count >= 20, F.concat(count, F.lit(" comparable facilities (20+ preferred).")))
        .otherwise(F.concat(F.lit("Only "), count, F.lit(" comparable facilities (20+ preferred)."))),
        F.when(used, F.concat(F.lit("Trend based on "), F.size(trend_years).cast("string"), F.lit(" reporting years.")))
        .otherwise("Fewer than 3 usable years: score uses peer percentile only."),
        F.when(~confirmed, "Facility-to-school match is not fully confirmed."),
        F.when(incomplete, "Some reported fields are missing."),
    )
    suppressed = short | blocked
    return F.struct(
        suppressed.alias("suppressed"),
        F.when(~suppressed, F.floor(raw * 100 + 0.5).cast("int")).alias("score"),
        F.when(~suppressed, F.when(points >= 5, "High").when(points >= 3, "Medium").otherwise("Low")).alias("confidence"),
        F.when(~suppressed, used).alias("used_trend"),
        F.when(short, F.array(F.lit("Insufficient comparable facilities for a reliable peer benchmark.")))
        .when(
            blocked,
            F.array(F.concat(F.lit("Data quality issues prevent a reliable score ("), F.array_join(blocking, ", "), F.lit(")."))),
        )
        .otherwise(reasons)
        .alias("reasons"),
    )


def data_confidence(
    match_confidence: Column,
    match_methods: Column,
    latest: Column,
    years_reported: Column,
    peer_count: Column,
    has_coordinates: Column,
    large_change: Column,
) -> Column:
    """STRUCT(level, reasons ARRAY<STRUCT<severity, text>>).

    ``latest`` is NULL or a struct with floor_area_m2, total_site_energy_gj, facility_count,
    total_derived and quality_flags of the newest reported year.
    """

    def reason(when: Column, severity: str, text: str | Column) -> Column:
        body = F.lit(text) if isinstance(text, str) else text
        return F.when(when, F.struct(F.lit(severity).alias("severity"), body.alias("text")))

    reported = latest.isNotNull()
    flags = F.coalesce(latest["quality_flags"], F.array().cast("array<string>"))

    def flagged(name: str) -> Column:
        return reported & F.array_contains(flags, name)

    weak = match_confidence < 0.95
    reasons = _texts(
        reason(match_confidence.isNull(), "limiting", "No public energy-reporting facility is confidently matched to this school."),
        reason(weak, "caution", "The facility-to-school match relies on name similarity rather than an exact name or address."),
        reason(~weak & F.array_contains(match_methods, "override"), "info", "The facility-to-school match was verified manually."),
        reason(
            reported & (latest["floor_area_m2"].isNull() | F.array_contains(flags, "nonpositive_floor_area")),
            "limiting",
            "Usable floor-area data is unavailable for the latest reporting period.",
        ),
        reason(
            reported & latest["total_site_energy_gj"].isNull(),
            "limiting",
            "Total energy is missing for the latest reporting period.",
        ),
        reason(flagged("negative_energy_value"), "limiting", "The latest report contains a negative energy value."),
        reason(
            flagged("implausible_intensity"),
            "limiting",
            "The reported energy, emissions, or floor area give an intensity outside the physically plausible range for a "
            "school building; the source values are shown as published but are not benchmarked.",
        ),
        reason(
            flagged("duplicate_facility_year"),
            "caution",
            "The source contains a duplicate record for this facility and year.",
        ),
        reason(
            reported & F.exists(flags, lambda f: f.startswith("unrecognized_unit")),
            "limiting",
            "A reported quantity used a unit that could not be interpreted.",
        ),
        reason(
            reported & (F.array_contains(flags, "multiple_facilities_combined") | (latest["facility_count"] > 1)),
            "info",
            F.concat(latest["facility_count"].cast("string"), F.lit(" reported facilities are combined for this school.")),
        ),
        reason(
            reported & latest["total_derived"],
            "info",
            "Total energy is derived from the ministry's reported intensity × floor area.",
        ),
        reason(peer_count < 10, "limiting", "There are not enough comparable facilities to calculate a reliable percentile."),
        reason(
            (peer_count >= 10) & (peer_count < 20),
            "caution",
            F.concat(F.lit("The peer group has "), peer_count.cast("string"), F.lit(" facilities (20+ preferred).")),
        ),
        reason(years_reported < 3, "caution", "Fewer than three reporting years are available, so trends are not calculated."),
        reason(large_change, "caution", "The latest year differs from the previous year by more than 30%."),
        reason(~has_coordinates, "info", "No official coordinates are available, so the school is not shown on the map."),
    )
    level = (
        F.when(F.exists(reasons, lambda r: r["severity"] == "limiting"), "Low")
        .when(F.exists(reasons, lambda r: r["severity"] == "caution"), "Medium")
        .otherwise("High")
    )
    return F.struct(level.alias("level"), reasons.alias("reasons"))

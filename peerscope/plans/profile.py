"""School profiles, reports and comparisons, computed for all schools as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions import display as D
from peerscope.functions.units import PANDEMIC_YEARS
from peerscope.operators.entities import combine_yearly, with_year_gaps, year_over_year
from peerscope.operators.score import data_confidence
from peerscope.operators.trend import trend_per_entity

_METRIC = [
    "reporting_year", "peer_count", "eui_percentile", "opportunity_score", "score_confidence", "score_reasons", "energy_gap_gj",
    "peer_stage", "peer_criteria", "peer_q25_eui", "peer_median_eui", "peer_q75_eui",
]


def yearly_series(energy: DataFrame, facilities: DataFrame, pandemic_years: Sequence[int] = PANDEMIC_YEARS) -> DataFrame:
    """Yearly series of every school over its matched facilities."""
    links = facilities.filter("school_id is not null").select("facility_id", "school_id")
    return combine_yearly(energy.join(links, "facility_id"), "school_id", pandemic_years)


def chart_rows(series: DataFrame) -> DataFrame:
    """The series with a row for every missing year."""
    return with_year_gaps(series, "school_id")


def profile_views(
    schools: DataFrame, facilities: DataFrame, series: DataFrame, metrics: DataFrame, pandemic_years: Sequence[int] = PANDEMIC_YEARS
) -> DataFrame:
    """One row per school: latest year, latest metric, exact 3- and 5-year trends, confidence.

    Everything is aggregated to one row per school before joining, so the joins meet on equal,
    co-partitioned keys and nothing fans out.
    """
    latest = [c for c in series.columns if c not in ("school_id", "year")]
    newest = series.groupBy("school_id").agg(
        F.max_by(F.struct("year", *latest), "year").alias("latest"),
        F.count("*").alias("years_reported"),
        F.array_sort(F.collect_list("year")).alias("years"),  # one entry a year
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )
    eui = series.filter("eui is not null").select("school_id", "year", F.col("eui").alias("value"))
    trends = trend_per_entity(eui, "school_id", windows=(("trend3_", 3, 3), ("trend5_", 5, 5)), pandemic_years=pandemic_years)
    changes = year_over_year(eui, "school_id", pandemic_years=pandemic_years).groupBy("school_id").agg(
        F.max_by(F.struct("year", "change_pct", "large"), "year").alias("change")
    )
    matched = facilities.filter("school_id is not null").groupBy("school_id").agg(
        F.min("match_confidence").alias("match_confidence"),
        F.collect_set("match_method").alias("match_methods"),  # five possible methods
        F.count("*").alias("facilities"),
    )
    metric = metrics.filter("school_id is not null").groupBy("school_id").agg(F.max_by(F.struct(*_METRIC), "reporting_year").alias("metric"))
    rows = schools
    for part in (newest, trends, changes, matched, metric):
        rows = rows.join(part, "school_id", "left")
    same_year = F.col("change.year") == F.col("latest.year")
    confidence = data_confidence(
        F.col("match_confidence"),
        F.coalesce("match_methods", F.array().cast("array<string>")),
        F.col("latest"),
        F.coalesce("years_reported", F.lit(0)),
        F.coalesce("metric.peer_count", F.lit(0)),
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        F.coalesce(same_year & F.col("change.large"), F.lit(False)),
    )
    return (
        rows.withColumn("confidence", confidence)
        .withColumn("latest_change_pct", F.when(same_year, F.col("change.change_pct")))
        .withColumn("has_energy_data", F.col("facilities").isNotNull() & F.col("years_reported").isNotNull())
        .drop("change")
    )


def school_profiles(schools: DataFrame, boards: DataFrame, facilities: DataFrame, series: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per school with its board: facilities (by id), series (by year), metrics (by year) and the latest metric.

    Each part is combined to one row per school where it is read; a school has few facilities and a row a year. Schools
    without a part have an empty array.
    """
    facility = F.struct("facility_id", "facility_name", "operation_type", "match_method", "match_confidence")
    year = F.struct("year", *[c for c in series.columns if c not in ("school_id", "year")])
    metric = F.struct(*_METRIC)
    parts = {
        "facilities": facilities.filter("school_id is not null").groupBy("school_id").agg(F.collect_list(facility).alias("facilities")),
        "series": series.groupBy("school_id").agg(F.collect_list(year).alias("series")),
        "metrics": metrics.filter("school_id is not null").groupBy("school_id").agg(F.collect_list(metric).alias("metrics")),
    }

    def ordered(name: str, key: str) -> Column:
        return F.array_sort(name, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))

    keys = {"facilities": "facility_id", "series": "year", "metrics": "reporting_year"}
    rows = schools.join(boards.select("board_number", F.col("name").alias("board_name"), F.col("slug").alias("board_slug")), "board_number")
    for name, part in parts.items():
        kind = part.schema[name].dataType.simpleString()
        rows = rows.join(part.withColumn(name, ordered(name, keys[name])), "school_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows.withColumn("latest", F.try_element_at("metrics", F.lit(-1)))


def _score_text() -> Column:
    metric = F.col("metric")
    shown = F.concat(
        metric["opportunity_score"].cast("string"), F.lit(" / 100 — "), metric["score_confidence"], F.lit(" confidence. "),
        D.percentile(metric["eui_percentile"]), F.lit(" for energy intensity among "),
        D.number(metric["peer_count"]), F.lit(" comparable facilities."),
    )
    reason = F.coalesce(F.try_element_at(metric["score_reasons"], F.lit(1)), F.lit("insufficient data for a reliable score."))
    return F.when(metric["opportunity_score"].isNotNull(), shown).otherwise(F.concat(F.lit("Not shown: "), reason))


def _gap_text() -> Column:
    gap = F.col("metric.energy_gap_gj")
    return (
        F.when(gap.isNull(), "Not available for this school.")
        .when(gap > 0, F.concat(F.lit("Approximately "), D.gj(gap), F.lit(" per year.")))
        .otherwise("Energy intensity is at or below the peer median; the modeled gap is zero.")
    )


def school_reports(views: DataFrame, boards: DataFrame) -> DataFrame:
    """Report texts per school."""
    latest = F.col("latest")
    peers = F.concat_ws("; ", F.concat(F.col("metric.peer_criteria"), F.array_compact(F.array("metric.peer_stage"))))
    enough = (F.col("metric.peer_count") >= 10) & latest["eui"].isNotNull()
    named = boards.select("board_number", F.col("name").alias("board_name"))
    return views.join(named, "board_number").select(
        "slug",
        "name",
        F.concat_ws(" · ", "board_name", D.school_level(F.col("school_level")), F.coalesce("city", F.lit(""))).alias("subtitle"),
        F.coalesce(latest["year"].cast("string"), F.lit(D.MISSING)).alias("latest_year"),
        "has_energy_data",
        D.gj(latest["total_site_energy_gj"]).alias("total_energy"),
        D.eui(latest["eui"]).alias("eui"),
        D.ghg_intensity(latest["ghg_intensity"]).alias("ghg_intensity"),
        D.area(latest["floor_area_m2"]).alias("floor_area"),
        _score_text().alias("score"),
        D.year_range(F.coalesce("years", F.array().cast("array<int>"))).alias("years"),
        F.when(F.col("trend3_pct").isNotNull(), F.concat(D.signed_percent(F.col("trend3_pct")), F.lit("/yr"))).otherwise(D.MISSING).alias("trend3"),
        F.when(F.col("trend5_pct").isNotNull(), F.concat(D.signed_percent(F.col("trend5_pct")), F.lit("/yr"))).otherwise(D.MISSING).alias("trend5"),
        F.when(enough, peers).alias("peer_group"),
        _gap_text().alias("gap"),
        F.col("confidence.level").alias("data_confidence"),
        F.array_join(F.transform("confidence.reasons", lambda x: x["text"]), " ").alias("data_notes"),
        F.coalesce(F.array_join("sources", ", "), F.lit("")).alias("sources"),
    )


def parse_slugs(text: str, most: int = 4) -> list[str]:
    """Distinct well-formed slugs of a comma-separated list, the first four."""
    import re

    parts = [p.strip() for p in text.split(",")]
    return list(dict.fromkeys(p for p in parts if re.fullmatch(r"[a-z0-9-]{1,200}", p)))[:most]


def comparison_values(views: DataFrame) -> DataFrame:
    """(slug, label, value): the comparison table in long form for every given school."""
    latest, metric = F.col("latest"), F.col("metric")
    score = F.concat(metric["opportunity_score"].cast("string"), F.lit(" ("), metric["score_confidence"], F.lit(")"))
    rows = [
        ("School level", D.school_level(F.col("school_level"))),
        ("Latest reporting year", F.coalesce(latest["year"].cast("string"), F.lit(D.MISSING))),
        ("Energy Use Intensity", D.eui(latest["eui"])),
        ("GHG intensity", D.ghg_intensity(latest["ghg_intensity"])),
        ("Peer percentile (EUI)", F.when(metric["peer_count"] >= 10, D.percentile(metric["eui_percentile"])).otherwise(D.MISSING)),
        ("Opportunity score", F.coalesce(score, F.lit(D.MISSING))),
        ("5-year trend", F.when(F.col("trend5_pct").isNotNull(), F.concat(D.signed_percent(F.col("trend5_pct")), F.lit("/yr"))).otherwise(D.MISSING)),
        ("Total site energy", D.gj(latest["total_site_energy_gj"])),
        ("Floor area", D.area(latest["floor_area_m2"])),
        ("Data confidence", F.when(F.col("has_energy_data"), F.col("confidence.level")).otherwise("No energy data")),
    ]
    pairs = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(rows)])
    return views.select("slug", F.explode(pairs).alias("_p")).select("slug", "_p.*")


def compare(views: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """One row per measure and one column per school; unknown slugs are dropped."""
    long = comparison_values(views.filter(F.col("slug").isin(*slugs)))
    return long.groupBy("row", "label").pivot("slug", list(slugs)).agg(F.max("value")).orderBy("row").drop("row")


def compare_series(series: DataFrame, schools: DataFrame, slugs: Sequence[str], metric: str = "eui") -> DataFrame:
    """Years as rows and one column per school."""
    wanted = schools.filter(F.col("slug").isin(*slugs)).select("school_id", "slug")
    return series.join(wanted, "school_id").groupBy("year").pivot("slug", list(slugs)).agg(F.max(metric)).orderBy("year")

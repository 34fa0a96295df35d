"""The benchmark from facility-years to one result row per entity-year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.functions.stats import anomaly_label
from peerscope.functions.units import PANDEMIC_YEARS, gap_to_median, usable_as_peer
from peerscope.operators.cohort import POOL_LIMIT, peer_statistics, stage_label
from peerscope.operators.entities import combine_entity_years
from peerscope.operators.score import opportunity_score
from peerscope.operators.trend import trend_as_known
from peerscope.session import materialize

NO_EUI = "Energy intensity cannot be calculated: usable floor area or total energy is missing."


def peer_metrics(
    records: DataFrame, pandemic_years: Sequence[int] = PANDEMIC_YEARS, pool_limit: int = POOL_LIMIT
) -> DataFrame:
    """Benchmark every entity-year.

    Entity-years are written once: pool sizes, peer statistics and trends read them separately.
    Peer lists are not stored with the rows, they would make the result grow with rows x peers.
    """
    entities = materialize(combine_entity_years(records))
    usable = usable_as_peer(F.col("quality_flags"))
    statistics = peer_statistics(entities, usable, pool_limit)
    trended = trend_as_known(entities, "entity_key", "reporting_year", "eui", usable, pandemic_years=pandemic_years)
    joined = trended.join(statistics, ["entity_key", "reporting_year"], "left")
    known = F.col("eui").isNotNull()
    criteria = F.array_compact(
        F.array(
            F.concat(F.lit("Operation type: "), "operation_category"),
            F.when(F.col("school_level").isNotNull(), F.concat(F.lit("School level: "), "school_level")),
        )
    )
    none = F.array().cast("array<string>")
    rows = (
        joined.withColumn("peer_count", F.coalesce("peer_count", F.lit(0)))
        .withColumn("trend_annual_pct", F.when(known, F.col("trend_pct")))
        .withColumn("trend_years", F.when(known, F.col("trend_years")).otherwise(F.array().cast("array<int>")))
        .withColumn(
            "_s",
            opportunity_score(
                F.col("eui_percentile"), F.col("peer_count"), F.col("trend_annual_pct"), F.col("trend_years"),
                F.col("match_confidence"), F.col("quality_flags"),
            ),
        )
    )
    return rows.select(
        "entity_key",
        "school_id",
        "facility_id",
        "reporting_year",
        "facility_count",
        "operation_category",
        "school_level",
        "eui",
        "ghg_intensity",
        "electricity_intensity",
        stage_label(F.col("peer_stage")).alias("peer_stage"),
        F.when(known, criteria).otherwise(none).alias("peer_criteria"),
        "peer_count",
        "eui_percentile",
        "ghg_percentile",
        "peer_median_eui",
        "peer_q25_eui",
        "peer_q75_eui",
        gap_to_median(F.col("eui"), F.col("peer_median_eui"), F.col("floor_area_m2")).alias("energy_gap_gj"),
        "eui_robust_z",
        anomaly_label(F.col("eui_robust_z")).alias("anomaly_label"),
        "trend_annual_pct",
        "trend_years",
        F.col("_s.score").alias("opportunity_score"),
        F.col("_s.confidence").alias("score_confidence"),
        F.when(known, F.col("_s.reasons")).otherwise(F.array(F.lit(NO_EUI))).alias("score_reasons"),
    )

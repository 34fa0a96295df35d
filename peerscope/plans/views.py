"""Benchmarking tables derived from the TPC-H-like test tables.

Nations are boards, customers are facilities, pairs of customers are schools, and yearly order
totals are energy records. ``VIEWS_SQL`` states the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.functions import units as U

DISRUPTED_YEARS = (1998, 1999)  # the test orders span 1995 to 2001


class Tables:
    """Lazily read parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def pseudo_word(seed: Column, start: int, length: int) -> Column:
    letters = F.translate(F.md5(seed.cast("string")), "0123456789abcdef", "abcdefghijklmnop")
    return F.substr(letters, F.lit(start), F.lit(length))


def boards(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("board_number"),
        F.concat("n_name", F.lit(" DSB")).alias("name"),
        F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit("-dsb")).alias("slug"),
        F.col("r_name").alias("region"),
    )


def _members(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    one, two = pseudo_word(key, 1, 7), pseudo_word(key, 8, 6)
    level = (
        F.when(key % 60 == 7, "combined").when(key % 7 == 0, None).when((key % 7).isin(1, 2), "secondary").otherwise("elementary")
    )
    perturbed = (
        F.when(key % 6 == 1, F.concat(one, F.lit(" "), two, F.lit(" P.S.")))
        .when(key % 6 == 2, F.concat(two, F.lit(" "), one, F.lit(" Public School")))
        .when(key % 6 == 3, F.concat(F.substr(one, F.lit(2)), F.lit(" "), two, F.lit(" Public School")))
        .when(key % 6 == 4, F.concat(pseudo_word(key + 1000003, 1, 9), F.lit(" Centre")))
        .otherwise(F.concat(one, F.lit(" "), two, F.lit(" Public School")))
    )
    street = F.concat((key % 900 + 1).cast("string"), F.lit(" "), two)
    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "School")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "École")
        .when(F.col("c_mktsegment") == "FURNITURE", "K-12 School")
        .when(F.col("c_mktsegment") == "MACHINERY", "Administrative offices and related facilities")
        .otherwise("Adult education")
    )
    return t.customer.select(
        key.alias("facility_id"),
        F.concat(one, F.lit(" "), two, F.lit(" Public School")).alias("name"),
        perturbed.alias("facility_name"),
        F.concat(street, F.lit(" Street")).alias("school_street"),
        F.when(key % 4 != 2, F.concat(street, F.lit(" St."))).alias("street"),
        F.col("c_mktsegment").alias("city"),
        F.col("c_nationkey").cast("string").alias("board_number"),
        kind.alias("operation_type"),
        level.alias("level"),
        F.col("c_acctbal").alias("area"),
        F.floor(key / 2).cast("long").alias("pair"),
    )


def facilities(t: Tables) -> DataFrame:
    key = F.col("facility_id")
    matched = key % 4 != 0
    method = (
        F.when(key % 13 == 0, "override")
        .when(key % 5 == 0, "name_city_board")
        .when((key % 5).isin(1, 2), "address_board")
        .otherwise("exact_name_board")
    )
    confidence = F.when(method == "name_city_board", 0.85).when(method == "address_board", 0.95).otherwise(1.0)
    status = (
        F.when(matched, "matched").when(key % 40 == 0, "rejected").when(key % 8 == 0, "ambiguous").otherwise("unmatched")
    )
    return _members(t).select(
        key,
        "facility_name",
        "street",
        "city",
        "board_number",
        "operation_type",
        F.when(matched, F.col("pair")).alias("school_id"),
        status.alias("match_status"),
        F.when(matched, method).alias("match_method"),
        F.when(matched, confidence).alias("match_confidence"),
    )


def schools(t: Tables) -> DataFrame:
    member = _members(t).filter(F.col("facility_id") % 4 != 0)
    first = F.min_by(
        F.struct("name", F.col("school_street").alias("street"), "city", "board_number", F.col("level").alias("school_level")),
        "facility_id",
    )
    one = member.groupBy(F.col("pair").alias("school_id")).agg(first.alias("_m")).select("school_id", "_m.*")
    number = F.col("school_id")
    located = number % 3 != 0
    region = boards(t).select("board_number", "region")
    return one.join(region, "board_number").select(
        number,
        number.cast("string").alias("school_number"),
        "name",
        F.concat(F.replace(F.lower("name"), F.lit(" "), F.lit("-")), F.lit("-"), number.cast("string")).alias("slug"),
        "board_number",
        "school_level",
        "region",
        "street",
        "city",
        F.when(located, 43 + (number % 100) / 100).alias("latitude"),
        F.when(located, -79 - (number % 50) / 100).alias("longitude"),
        (number % 20 != 0).alias("active"),
    )


def energy_records(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")

    def total(status: str | None = None) -> Column:
        return F.sum(price if status is None else F.when(F.col("o_orderstatus") == status, price)).cast("double")

    grain = t.orders.groupBy(F.col("o_custkey").alias("facility_id"), F.year("o_orderdate").alias("reporting_year")).agg(
        total().alias("t"), total("F").alias("f"), total("O").alias("o"), total("P").alias("p")
    )
    key, year = F.col("facility_id"), F.col("reporting_year")
    joined = grain.join(_members(t).select("facility_id", "area", "operation_type"), "facility_id")
    energy = F.when((key % 17 == 5) & (year % 2 == 0), None).when((key % 43 == 11) & (year == 1998), 0.0).otherwise(F.col("t") / 100)
    measured = joined.select(
        key,
        year,
        energy.alias("total_site_energy_gj"),
        F.when(key % 3 != 0, energy * 1.05).alias("normalized_total_energy_gj"),
        (F.col("o") / 10).alias("electricity_kwh"),
        (F.col("o") / 10 * U.GJ_PER_KWH).alias("electricity_gj"),
        F.when(key % 29 == 6, -F.col("p") / 100).otherwise(F.col("p") / 100).alias("natural_gas_gj"),
        F.when(key % 3 == 1, F.col("p") / 10).alias("natural_gas_m3"),
        F.lit(None).cast("double").alias("fuel_oil_gj"),
        F.lit(None).cast("double").alias("other_energy_gj"),
        F.col("f").alias("ghg_kg_co2e"),
        F.when(key % 23 != 4, F.col("area")).alias("floor_area_m2"),
        F.when(key % 10 != 3, (30 + key % 40).cast("double")).alias("weekly_hours"),
        (key % 5).cast("int").alias("portable_count"),
        "operation_type",
        F.when(year >= 2000, F.make_date(year + 1, F.lit(8), F.lit(31))).alias("reporting_period_end"),
        F.concat(F.lit("energy-"), year.cast("string"), F.lit(".csv")).alias("source_resource"),
    )
    given = F.array_compact(
        F.array(
            F.when(key % 37 == 9, F.lit("unrecognized_unit:floor_area")),
            F.when(key % 41 == 10, F.lit("total_energy_derived_from_reported_intensity")),
            F.when((key % 31 == 8) & (year == 1997), F.lit("duplicate_facility_year")),
        )
    )
    flags = U.quality_flags(F.col, year, pandemic_years=DISRUPTED_YEARS)
    return measured.withColumn("data_quality_flags", F.concat(given, flags))


def facility_years(t: Tables) -> DataFrame:
    """Energy records with match and school level: the input of the benchmark."""
    links = facilities(t).select(
        "facility_id", "school_id", F.when(F.col("match_status") == "matched", F.col("match_confidence")).alias("match_confidence")
    )
    levels = schools(t).select("school_id", "school_level")
    return (
        energy_records(t)
        .join(links, "facility_id")
        .join(levels, "school_id", "left")
        .withColumn("quality_flags", F.col("data_quality_flags"))
    )


_WORD = "translate(md5(CAST({0} AS VARCHAR)), '0123456789abcdef', 'abcdefghijklmnop')"
_ONE, _TWO = f"substr({_WORD.format('c_custkey')}, 1, 7)", f"substr({_WORD.format('c_custkey')}, 8, 6)"

VIEWS_SQL = f"""WITH boards AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS board_number, n_name || ' DSB' AS name,
         lower(replace(n_name, '_', '-')) || '-dsb' AS slug, r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey),
members AS (
  SELECT c_custkey AS facility_id, {_ONE} || ' ' || {_TWO} || ' Public School' AS name,
         CASE c_custkey % 6 WHEN 1 THEN {_ONE} || ' ' || {_TWO} || ' P.S.'
              WHEN 2 THEN {_TWO} || ' ' || {_ONE} || ' Public School'
              WHEN 3 THEN substr({_ONE}, 2) || ' ' || {_TWO} || ' Public School'
              WHEN 4 THEN substr({_WORD.format('(c_custkey + 1000003)')}, 1, 9) || ' Centre'
              ELSE {_ONE} || ' ' || {_TWO} || ' Public School' END AS facility_name,
         CAST(c_custkey % 900 + 1 AS VARCHAR) || ' ' || {_TWO} || ' Street' AS school_street,
         CASE WHEN c_custkey % 4 <> 2 THEN CAST(c_custkey % 900 + 1 AS VARCHAR) || ' ' || {_TWO} || ' St.' END AS street,
         c_mktsegment AS city, CAST(c_nationkey AS VARCHAR) AS board_number,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'School' WHEN 'HOUSEHOLD' THEN 'École' WHEN 'FURNITURE' THEN 'K-12 School'
              WHEN 'MACHINERY' THEN 'Administrative offices and related facilities' ELSE 'Adult education' END AS operation_type,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'school' WHEN 'HOUSEHOLD' THEN 'school' WHEN 'FURNITURE' THEN 'school'
              WHEN 'MACHINERY' THEN 'administrative' ELSE 'other' END AS category,
         CASE WHEN c_custkey % 60 = 7 THEN 'combined' WHEN c_custkey % 7 = 0 THEN NULL
              WHEN c_custkey % 7 IN (1, 2) THEN 'secondary' ELSE 'elementary' END AS level,
         c_acctbal AS area, c_custkey // 2 AS pair
  FROM customer),
facilities AS (
  SELECT facility_id, facility_name, street, city, board_number, operation_type, category,
         CASE WHEN facility_id % 4 <> 0 THEN pair END AS school_id,
         CASE WHEN facility_id % 4 <> 0 THEN 'matched' WHEN facility_id % 40 = 0 THEN 'rejected'
              WHEN facility_id % 8 = 0 THEN 'ambiguous' ELSE 'unmatched' END AS match_status,
         CASE WHEN facility_id % 4 = 0 THEN NULL WHEN facility_id % 13 = 0 THEN 'override' WHEN facility_id % 5 = 0 THEN 'name_city_board'
              WHEN facility_id % 5 IN (1, 2) THEN 'address_board' ELSE 'exact_name_board' END AS match_method,
         CASE WHEN facility_id % 4 = 0 THEN NULL WHEN facility_id % 13 = 0 THEN 1.0::DOUBLE WHEN facility_id % 5 = 0 THEN 0.85::DOUBLE
              WHEN facility_id % 5 IN (1, 2) THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS match_confidence
  FROM members),
schools AS (
  SELECT pair AS school_id, CAST(pair AS VARCHAR) AS school_number, m.name,
         replace(lower(m.name), ' ', '-') || '-' || CAST(pair AS VARCHAR) AS slug, m.board_number, level AS school_level, region,
         school_street AS street, city,
         CASE WHEN pair % 3 <> 0 THEN 43 + (pair % 100) / 100 END AS latitude,
         CASE WHEN pair % 3 <> 0 THEN -79 - (pair % 50) / 100 END AS longitude, pair % 20 <> 0 AS active
  FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY facility_id) AS rn FROM members WHERE facility_id % 4 <> 0) m
  JOIN boards b ON m.board_number = b.board_number WHERE rn = 1),
grain AS (
  SELECT o_custkey AS facility_id, year(o_orderdate) AS reporting_year,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS o,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS p
  FROM orders GROUP BY ALL),
measured AS (
  SELECT g.*, operation_type, CASE WHEN facility_id % 17 = 5 AND reporting_year % 2 = 0 THEN NULL
              WHEN facility_id % 43 = 11 AND reporting_year = 1998 THEN 0.0::DOUBLE ELSE t / 100 END AS total_site_energy_gj,
         o / 10 AS electricity_kwh, o / 10 * 0.0036::DOUBLE AS electricity_gj,
         CASE WHEN facility_id % 29 = 6 THEN -p / 100 ELSE p / 100 END AS natural_gas_gj,
         CASE WHEN facility_id % 3 = 1 THEN p / 10 END AS natural_gas_m3, f AS ghg_kg_co2e,
         CASE WHEN facility_id % 23 <> 4 THEN area END AS floor_area_m2,
         CASE WHEN facility_id % 10 <> 3 THEN CAST(30 + facility_id % 40 AS DOUBLE) END AS weekly_hours,
         facility_id % 5 AS portable_count,
         CASE WHEN reporting_year >= 2000 THEN make_date(reporting_year + 1, 8, 31) END AS reporting_period_end,
         'energy-' || CAST(reporting_year AS VARCHAR) || '.csv' AS source_resource
  FROM grain g JOIN members USING (facility_id)),
energy AS (
  SELECT *, CASE WHEN facility_id % 3 <> 0 THEN total_site_energy_gj * 1.05::DOUBLE END AS normalized_total_energy_gj,
    list_filter([
      CASE WHEN facility_id % 37 = 9 THEN 'unrecognized_unit:floor_area' END,
      CASE WHEN facility_id % 41 = 10 THEN 'total_energy_derived_from_reported_intensity' END,
      CASE WHEN facility_id % 31 = 8 AND reporting_year = 1997 THEN 'duplicate_facility_year' END,
      CASE WHEN floor_area_m2 IS NULL THEN 'missing_floor_area' WHEN floor_area_m2 <= 0 THEN 'nonpositive_floor_area' END,
      CASE WHEN total_site_energy_gj IS NULL THEN 'missing_total_energy'
           WHEN total_site_energy_gj = 0 AND coalesce(electricity_kwh, 0) > 0 THEN 'zero_total_with_reported_consumption' END,
      CASE WHEN coalesce(natural_gas_gj < 0, false) OR coalesce(total_site_energy_gj < 0, false) THEN 'negative_energy_value' END,
      CASE WHEN floor_area_m2 > 0 AND (coalesce(total_site_energy_gj / floor_area_m2 NOT BETWEEN 0.05 AND 5.0, false)
             OR coalesce(ghg_kg_co2e / floor_area_m2 > 500, false)) THEN 'implausible_intensity' END,
      CASE WHEN reporting_year IN (1998, 1999) THEN 'pandemic_affected_period' END], lambda x: x IS NOT NULL) AS flags
  FROM measured),
records AS (
  SELECT e.*, f.school_id, f.category, s.school_level, CASE WHEN f.match_status = 'matched' THEN f.match_confidence END AS match_confidence
  FROM energy e JOIN facilities f USING (facility_id) LEFT JOIN schools s ON f.school_id = s.school_id),
entity_grain AS (
  SELECT CASE WHEN school_id IS NOT NULL THEN 's' || CAST(school_id AS VARCHAR) ELSE 'f' || CAST(facility_id AS VARCHAR) END AS entity_key,
         reporting_year, count(*) AS facility_count,
         arg_max({{'s': school_id, 'f': facility_id, 'c': category, 'l': school_level, 'h': weekly_hours}},
                 {{'a': coalesce(floor_area_m2, 0), 'b': -facility_id}}) AS main,
         CASE WHEN count(match_confidence) = count(*) THEN min(match_confidence) END AS match_confidence,
         CASE WHEN count(total_site_energy_gj) = count(*) THEN sum(total_site_energy_gj) END AS total_site_energy_gj,
         CASE WHEN count(floor_area_m2) = count(*) THEN sum(floor_area_m2) END AS floor_area_m2,
         CASE WHEN count(ghg_kg_co2e) = count(*) THEN sum(ghg_kg_co2e) END AS ghg_kg_co2e,
         CASE WHEN count(electricity_kwh) = count(*) THEN sum(electricity_kwh) END AS electricity_kwh,
         list_sort(list_distinct(flatten(list(flags)))) AS base_flags
  FROM records GROUP BY ALL),
entity_years AS (
  SELECT entity_key, reporting_year, facility_count, main.s AS school_id, CASE WHEN main.s IS NULL THEN main.f END AS facility_id,
         main.c AS category, main.l AS school_level, match_confidence, total_site_energy_gj, floor_area_m2, ghg_kg_co2e, electricity_kwh,
         CASE WHEN facility_count = 1 THEN main.h END AS weekly_hours,
         CASE WHEN facility_count > 1 THEN list_append(base_flags, 'multiple_facilities_combined') ELSE base_flags END AS flags,
         CASE WHEN total_site_energy_gj >= 0 AND floor_area_m2 > 0 THEN total_site_energy_gj / floor_area_m2 END AS eui,
         CASE WHEN ghg_kg_co2e >= 0 AND floor_area_m2 > 0 THEN ghg_kg_co2e / floor_area_m2 END AS ghg_intensity,
         CASE WHEN electricity_kwh >= 0 AND floor_area_m2 > 0 THEN electricity_kwh / floor_area_m2 END AS electricity_intensity,
         len(list_filter(flags, lambda x: x IN ('implausible_intensity', 'negative_energy_value', 'duplicate_facility_year',
             'nonpositive_floor_area', 'zero_total_with_reported_consumption') OR starts_with(x, 'unrecognized_unit'))) = 0 AS usable
  FROM entity_grain)"""

# brute force: every candidate of the same year and category, stage by stage
PEERS_SQL = VIEWS_SQL + """,
pairs AS (
  SELECT t.entity_key, t.reporting_year, c.eui AS peer_eui, c.ghg_intensity AS peer_ghg, t.weekly_hours AS th,
         c.floor_area_m2 / t.floor_area_m2 AS ratio, abs(c.weekly_hours - t.weekly_hours) / t.weekly_hours <= 0.25 AS same_hours
  FROM entity_years t JOIN entity_years c
    ON t.reporting_year = c.reporting_year AND t.category = c.category AND t.entity_key <> c.entity_key
   AND (t.school_level IS NULL OR t.school_level = c.school_level)
  WHERE t.eui IS NOT NULL AND c.eui IS NOT NULL AND c.usable),
staged AS (
  SELECT *, unnest([coalesce(th > 0 AND same_hours AND ratio BETWEEN 0.67 AND 1.5, false), ratio BETWEEN 0.67 AND 1.5,
                    ratio BETWEEN 0.5 AND 2, ratio BETWEEN 0.33 AND 3, true]) AS fits, unnest([0, 1, 2, 3, 4]) AS stage FROM pairs),
sizes AS (SELECT entity_key, reporting_year, stage, count(*) AS n FROM staged WHERE fits GROUP BY ALL),
chosen AS (
  SELECT entity_key, reporting_year, coalesce(min(stage) FILTER (n >= 20), min(stage) FILTER (n >= 10)) AS stage
  FROM sizes GROUP BY ALL HAVING max(n) >= 10),
peers AS (SELECT s.* FROM staged s JOIN chosen USING (entity_key, reporting_year, stage) WHERE fits),
centers AS (
  SELECT entity_key, reporting_year, stage, count(*) AS peer_count, median(peer_eui) AS med,
         quantile_cont(peer_eui, 0.25) AS q25, quantile_cont(peer_eui, 0.75) AS q75
  FROM peers GROUP BY ALL),
peer_stats AS (
  SELECT entity_key, reporting_year, any_value(c.stage) AS stage, any_value(peer_count) AS peer_count, any_value(med) AS med,
         any_value(q25) AS q25, any_value(q75) AS q75,
         100.0 * (count(*) FILTER (peer_eui < e.eui) + 0.5 * count(*) FILTER (peer_eui = e.eui)) / count(*) AS eui_percentile,
         CASE WHEN any_value(e.ghg_intensity) IS NOT NULL AND count(peer_ghg) >= 10 THEN
           100.0 * (count(*) FILTER (peer_ghg < e.ghg_intensity) + 0.5 * count(*) FILTER (peer_ghg = e.ghg_intensity)) / count(peer_ghg) END AS ghg_percentile,
         any_value(e.eui) AS own, median(abs(peer_eui - med)) AS mad, avg(abs(peer_eui - med)) AS mean_ad
  FROM peers JOIN centers c USING (entity_key, reporting_year) JOIN entity_years e USING (entity_key, reporting_year) GROUP BY ALL),
trend_points AS (
  SELECT e.entity_key, e.reporting_year, p.reporting_year AS y, p.eui AS v,
         row_number() OVER (PARTITION BY e.entity_key, e.reporting_year ORDER BY p.reporting_year DESC) AS rn
  FROM entity_years e JOIN entity_years p ON e.entity_key = p.entity_key AND p.reporting_year <= e.reporting_year
  WHERE e.eui IS NOT NULL AND p.eui > 0 AND p.usable AND p.reporting_year NOT IN (1998, 1999)),
trends AS (
  SELECT entity_key, reporting_year, regr_slope(v, y) / avg(v) * 100 AS trend_pct, list(y ORDER BY y) AS trend_years
  FROM trend_points WHERE rn <= 5 GROUP BY ALL HAVING count(*) >= 3),
metrics_base AS (
  SELECT e.*, stage, coalesce(peer_count, 0) AS peer_count, eui_percentile, ghg_percentile, med, q25, q75,
         CASE WHEN med IS NOT NULL THEN greatest(0, eui - med) * floor_area_m2 END AS energy_gap_gj,
         CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (own - med) / mad WHEN mean_ad > 0 THEN (own - med) / (sqrt(pi() / 2) * mean_ad)
              WHEN own = med THEN 0 END AS z, trend_pct, trend_years,
         list_filter(flags, lambda x: x IN ('implausible_intensity', 'negative_energy_value', 'duplicate_facility_year',
             'nonpositive_floor_area') OR starts_with(x, 'unrecognized_unit')) AS blocking
  FROM entity_years e LEFT JOIN peer_stats USING (entity_key, reporting_year) LEFT JOIN trends USING (entity_key, reporting_year)),
metrics AS (
  SELECT *, CASE WHEN z >= 3.5 THEN 'unusually_high' WHEN z >= 2 THEN 'elevated' WHEN z IS NOT NULL THEN 'typical' END AS anomaly_label,
    eui_percentile IS NULL OR peer_count < 10 OR len(blocking) > 0 AS suppressed,
    CASE WHEN NOT (eui_percentile IS NULL OR peer_count < 10 OR len(blocking) > 0) THEN
      CAST(floor(100 * CASE WHEN trend_pct IS NOT NULL
        THEN (eui_percentile / 100) * 0.8::DOUBLE + least(1, greatest(0, (trend_pct + 10) / 20)) * 0.2::DOUBLE ELSE eui_percentile / 100 END + 0.5) AS BIGINT) END AS opportunity_score,
    (CASE WHEN peer_count >= 20 THEN 2 ELSE 1 END) + (CASE WHEN trend_pct IS NOT NULL THEN 2 ELSE 0 END)
      + (CASE WHEN match_confidence >= 0.95 THEN 1 ELSE 0 END)
      - (CASE WHEN list_contains(flags, 'missing_total_energy') OR list_contains(flags, 'missing_floor_area') THEN 1 ELSE 0 END) AS points
  FROM metrics_base),
peer_metrics AS (
  SELECT *, CASE WHEN NOT suppressed THEN CASE WHEN points >= 5 THEN 'High' WHEN points >= 3 THEN 'Medium' ELSE 'Low' END END AS score_confidence
  FROM metrics)"""

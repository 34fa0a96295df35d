"""Aggregations, cohort statistics, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerscope.functions import stats as S
from peerscope.functions import units as U
from peerscope.operators import entities as E
from peerscope.operators import ranking as R
from peerscope.operators.trend import trend_as_known, trend_per_entity
from peerscope.plans import views as V
from peerscope.plans.registry import joined, query, r
from peerscope.session import materialize

VW = V.VIEWS_SQL


def _entities(t):
    return E.combine_entity_years(V.facility_years(t))


def _stored_entities(t):
    """Entity-years as a written table, for statistics that scan their input more than once."""
    return materialize(_entities(t))


_FIRST_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
     row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn,
     count(*) OVER (PARTITION BY l_partkey, year(l_shipdate)) AS copies, year(l_shipdate) AS y FROM lineitem)"""


def _lines(t):
    return t.lineitem.select(
        "l_partkey", F.year("l_shipdate").alias("y"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
        F.array(F.lit("as_read")).alias("data_quality_flags"),
    )


_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]


@query(
    "ag1_dedupe_kept",
    _FIRST_SQL + """ SELECT l_partkey, y, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, CASE WHEN copies > 1 THEN 'as_read|duplicate_facility_year' ELSE 'as_read' END AS flags
     FROM l WHERE rn = 1""",
)
def _(t):
    kept, _ = E.dedupe_facility_years(_lines(t), ["l_partkey", "y"], _ORDER)
    return kept.select("l_partkey", "y", "l_orderkey", "l_linenumber", "l_suppkey", joined("data_quality_flags").alias("flags"))


@query(
    "ag1_dedupe_rejected",
    _FIRST_SQL + " SELECT l_partkey, y, count(*) AS dropped, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM l WHERE rn > 1 GROUP BY ALL",
)
def _(t):
    _, rejected = E.dedupe_facility_years(_lines(t), ["l_partkey", "y"], _ORDER)
    return rejected.groupBy("l_partkey", "y").agg(F.count("*").alias("dropped"), F.sum("l_quantity").alias("quantity"))


@query(
    "ag2_directory_dedupe",
    """SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS name, count(*) - 1 AS duplicates FROM part GROUP BY p_brand""",
)
def _(t):
    first = E.first_per_key(t.part, ["p_brand"], ["p_partkey"])
    return first.select("p_brand", "p_partkey", F.col("p_name").alias("name"), (F.col("copies") - 1).alias("duplicates"))


@query(
    "ag3_latest_attributes",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       SELECT o_custkey, o_orderstatus, o_orderpriority, year(o_orderdate) AS latest_year FROM o WHERE rn = 1""",
)
def _(t):
    newest = E.latest_attributes(t.orders, "o_custkey", "o_orderdate", ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])
    return newest.withColumn("latest_year", F.year("latest_year"))


@query(
    "ag4_entity_years",
    VW + """ SELECT entity_key, reporting_year, facility_count, school_id, facility_id, category AS operation_category, school_level, match_confidence,
       round(total_site_energy_gj, 4) AS energy, round(floor_area_m2, 4) AS area, weekly_hours, array_to_string(flags, '|') AS flags, round(eui, 9) AS eui FROM entity_years""",
)
def _(t):
    return _entities(t).select(
        "entity_key", "reporting_year", "facility_count", "school_id", "facility_id", "operation_category", "school_level", "match_confidence",
        r("total_site_energy_gj", 4).alias("energy"), r("floor_area_m2", 4).alias("area"), "weekly_hours", joined("quality_flags").alias("flags"),
        r("eui", 9).alias("eui"),
    )


@query(
    "ag5_strict_sum",
    VW + """ SELECT board_number, reporting_year, round(CASE WHEN count(ghg_kg_co2e) = count(*) THEN sum(ghg_kg_co2e) END, 2) AS strict,
       round(sum(ghg_kg_co2e), 2) AS loose FROM energy JOIN facilities USING (facility_id) GROUP BY ALL""",
)
def _(t):
    rows = V.energy_records(t).join(V.facilities(t).select("facility_id", "board_number"), "facility_id")
    return rows.groupBy("board_number", "reporting_year").agg(
        r(E.sum_all("ghg_kg_co2e"), 2).alias("strict"), r(F.sum("ghg_kg_co2e"), 2).alias("loose")
    )


YEARLY_SQL = """, yearly AS (
  SELECT school_id, reporting_year AS year, count(*) AS facility_count, arg_min(coalesce(CAST(reporting_period_end AS VARCHAR), ''), facility_id) AS pe,
    CASE WHEN count(total_site_energy_gj) = count(*) THEN sum(total_site_energy_gj) END AS total,
    CASE WHEN count(normalized_total_energy_gj) = count(*) THEN sum(normalized_total_energy_gj) END AS normalized,
    CASE WHEN count(electricity_kwh) = count(*) THEN sum(electricity_kwh) END AS electricity,
    CASE WHEN count(natural_gas_gj) = count(*) THEN sum(natural_gas_gj) END AS gas_gj,
    CASE WHEN count(natural_gas_m3) = count(*) THEN sum(natural_gas_m3) END AS gas_m3,
    CASE WHEN count(ghg_kg_co2e) = count(*) THEN sum(ghg_kg_co2e) END AS ghg,
    CASE WHEN count(floor_area_m2) = count(*) THEN sum(floor_area_m2) END AS area,
    CASE WHEN count(*) = 1 THEN max(weekly_hours) END AS weekly_hours, CASE WHEN count(*) = 1 THEN max(portable_count) END AS portable_count,
    arg_min(operation_type, facility_id) AS operation_type, list_sort(list_distinct(flatten(list(flags)))) AS flags,
    array_to_string(list_sort(list_distinct(list(source_resource))), '|') AS sources
  FROM records WHERE school_id IS NOT NULL GROUP BY ALL),
series AS (SELECT *, CASE WHEN total >= 0 AND area > 0 THEN total / area END AS eui, CASE WHEN ghg >= 0 AND area > 0 THEN ghg / area END AS ghg_intensity,
    list_contains(flags, 'total_energy_derived_from_reported_intensity') AS total_derived, year IN (1998, 1999) AS pandemic_affected FROM yearly)"""


@query(
    "ag6_yearly_series",
    VW + YEARLY_SQL + """ SELECT school_id, year, facility_count, nullif(pe, '') AS period_end, round(total, 4) AS total, round(normalized, 6) AS normalized,
      round(electricity, 4) AS electricity, round(gas_gj, 4) AS gas_gj, round(gas_m3, 4) AS gas_m3, round(ghg, 4) AS ghg, round(area, 4) AS area, weekly_hours,
      portable_count, operation_type, round(eui, 9) AS eui, round(ghg_intensity, 9) AS ghg_intensity, total_derived, pandemic_affected,
      array_to_string(flags, '|') AS flags, sources FROM series""",
)
def _(t):
    s = E.combine_yearly(V.facility_years(t).filter("school_id is not null"), pandemic_years=V.DISRUPTED_YEARS)
    return s.select(
        "school_id", "year", "facility_count", F.col("period_end").cast("string").alias("period_end"),
        r("total_site_energy_gj", 4).alias("total"), r("normalized_total_energy_gj", 6).alias("normalized"), r("electricity_kwh", 4).alias("electricity"),
        r("natural_gas_gj", 4).alias("gas_gj"), r("natural_gas_m3", 4).alias("gas_m3"), r("ghg_kg_co2e", 4).alias("ghg"), r("floor_area_m2", 4).alias("area"),
        "weekly_hours", "portable_count", "operation_type", r("eui", 9).alias("eui"), r("ghg_intensity", 9).alias("ghg_intensity"),
        "total_derived", "pandemic_affected", joined("quality_flags").alias("flags"), joined("sources").alias("sources"),
    )


@query(
    "ag7_yearly_totals",
    VW + """ SELECT reporting_year AS year, count(*) AS facilities, round(sum(total_site_energy_gj) FILTER (NOT list_contains(flags, 'implausible_intensity')), 4) AS energy,
      round(sum(ghg_kg_co2e) FILTER (NOT list_contains(flags, 'implausible_intensity')), 2) AS ghg,
      count(*) FILTER (list_contains(flags, 'implausible_intensity')) AS excluded FROM energy GROUP BY ALL""",
)
def _(t):
    from peerscope.plans.reads import yearly_totals

    return yearly_totals(V.energy_records(t)).select(
        "year", "facilities", r("total_energy_gj", 4).alias("energy"), r("total_ghg_kg", 2).alias("ghg"), F.col("excluded_implausible").alias("excluded")
    )


@query(
    "ag8_aggregate_eui",
    VW + """, p AS (SELECT *, NOT list_contains(flags, 'implausible_intensity') AND floor_area_m2 > 0 AND total_site_energy_gj IS NOT NULL AS ok FROM energy JOIN facilities USING (facility_id))
      SELECT board_number, reporting_year AS year, round(sum(total_site_energy_gj) FILTER (ok) / nullif(sum(floor_area_m2) FILTER (ok), 0), 9) AS aggregate_eui FROM p GROUP BY ALL""",
)
def _(t):
    from peerscope.plans.reads import aggregate_eui

    rows = V.energy_records(t).join(V.facilities(t).select("facility_id", "board_number"), "facility_id")
    return rows.groupBy("board_number", F.col("reporting_year").alias("year")).agg(r(aggregate_eui(), 9).alias("aggregate_eui"))


@query(
    "ag9_median_per_group",
    VW + " SELECT reporting_year, category AS operation_category, count(eui) AS n, round(median(eui), 9) AS median_eui FROM entity_years GROUP BY ALL",
)
def _(t):
    q = R.exact_quantiles(_stored_entities(t), ["reporting_year", "operation_category"], F.col("eui"), {"m": 0.5})
    return q.select("reporting_year", "operation_category", "n", r("m", 9).alias("median_eui"))


@query(
    "ag10_distinct_and_span",
    "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT year(o_orderdate)) AS years, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders GROUP BY ALL",
)
def _(t):
    year = F.year("o_orderdate")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct(year).alias("years"), F.min(year).alias("first"), F.max(year).alias("last")
    )


@query(
    "ag11_group_by_level",
    VW + " SELECT school_level, reporting_year, count(*) AS schools, round(median(eui), 9) AS median_eui FROM entity_years WHERE school_id IS NOT NULL AND eui IS NOT NULL GROUP BY ALL",
)
def _(t):
    rows = _stored_entities(t).filter("school_id is not null and eui is not null")
    q = R.exact_quantiles(rows, ["school_level", "reporting_year"], F.col("eui"), {"m": 0.5})
    return q.select("school_level", "reporting_year", F.col("n").alias("schools"), r("m", 9).alias("median_eui"))


@query(
    "ag12_flagged_records",
    VW + " SELECT count(*) FILTER (len(flags) > 0) AS flagged, count(*) FILTER (list_contains(flags, 'implausible_intensity')) AS implausible FROM energy",
)
def _(t):
    flags = F.col("data_quality_flags")
    return V.energy_records(t).agg(F.count_if(F.size(flags) > 0).alias("flagged"), F.count_if(~U.plausible(flags)).alias("implausible"))


@query(
    "ag13_run_summary",
    VW + """ SELECT 'flag' AS section, f AS label, count(*) AS n FROM (SELECT unnest(flags) AS f FROM energy) GROUP BY ALL
      UNION ALL SELECT 'status', match_status, count(*) FROM facilities GROUP BY ALL
      UNION ALL SELECT 'method', match_method, count(*) FROM facilities WHERE match_status = 'matched' GROUP BY ALL
      UNION ALL SELECT 'type', operation_type, count(*) FROM energy GROUP BY ALL
      UNION ALL SELECT 'high confidence', 'matched', count(*) FROM facilities WHERE match_status = 'matched' AND match_confidence >= 0.9
      UNION ALL SELECT * FROM (SELECT 'period end ' || reporting_year, coalesce(CAST(reporting_period_end AS VARCHAR), 'not reported') AS e, count(*) FROM energy GROUP BY ALL)""",
)
def _(t):
    from peerscope.plans.ingest import run_counts

    return run_counts(V.energy_records(t), V.facilities(t))


@query(
    "ag14_value_counts",
    """WITH u AS (SELECT 'p_type' AS "column", p_type AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
       c AS (SELECT "column", value, count(*) AS count FROM u GROUP BY ALL)
       SELECT "column", value, count, position FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS position FROM c) WHERE position <= 10""",
)
def _(t):
    from peerscope.sources.grids import profile_columns

    return profile_columns(t.part, ["p_type", "p_brand", "p_size"])


@query(
    "ag14_missing_share",
    """WITH e AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS b FROM orders)
       SELECT 'a' AS "column", round(avg(CASE WHEN a IS NULL THEN 1 ELSE 0 END) * 100, 1) AS missing_pct, count(DISTINCT a) AS distinct_values FROM e
       UNION ALL SELECT 'b', round(avg(CASE WHEN b IS NULL THEN 1 ELSE 0 END) * 100, 1), count(DISTINCT b) FROM e""",
)
def _(t):
    from peerscope.sources.grids import missing_share

    rows = t.orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("b"))
    return missing_share(rows, ["a", "b"])


_SOURCE = """src AS (SELECT o_orderkey AS row, o_orderstatus AS sector, 'board ' || o_custkey % 97 AS organization, CASE WHEN o_orderkey % 5 > 0 THEN 'kind ' || year(o_orderdate) END AS operation,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'u' || o_custkey % 13 END AS area_unit, o_orderstatus <> 'O' AS member FROM orders)"""


@query(
    "ag14_source_profile",
    f"""WITH {_SOURCE}, m AS (SELECT * FROM src WHERE member),
      v AS (SELECT 'sectors' AS section, 'sector' AS "column", sector AS value, count(*) AS n, 25 AS most FROM src GROUP BY ALL
        UNION ALL SELECT 'operation types', 'operation', operation, count(*), 30 FROM m GROUP BY ALL UNION ALL SELECT 'units', 'area_unit', area_unit, count(*), 10 FROM m GROUP BY ALL),
      s AS (SELECT *, row_number() OVER (ORDER BY row) AS nth FROM m ORDER BY row LIMIT 2)
      SELECT section, "column", value, CAST(n AS DOUBLE) AS n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, value NULLS FIRST) AS at_place FROM v) WHERE at_place <= most
      UNION ALL SELECT 'rows', NULL, NULL, count(*) FROM src UNION ALL SELECT 'sector rows', NULL, NULL, count(*) FROM m UNION ALL SELECT 'sector organizations', 'organization', NULL, count(DISTINCT organization) FROM m
      UNION ALL SELECT 'missing per cent', c, NULL, round(avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) * 100, 1) FROM (SELECT unnest(['sector', 'organization', 'operation', 'area_unit']) AS c, unnest([sector, organization, operation, area_unit]) AS v FROM m) GROUP BY c
      UNION ALL SELECT 'sample ' || nth, unnest(['sector', 'organization', 'operation', 'area_unit']), unnest([sector, organization, operation, area_unit]), NULL FROM s""",
)
def _(t):
    from peerscope.sources.grids import source_profile

    key = F.col("o_orderkey")
    rows = t.orders.select(
        key.alias("row"), F.col("o_orderstatus").alias("sector"), F.concat(F.lit("board "), (F.col("o_custkey") % 97).cast("string")).alias("organization"),
        F.when(key % 5 > 0, F.concat(F.lit("kind "), F.year("o_orderdate").cast("string"))).alias("operation"),
        F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("u"), (F.col("o_custkey") % 13).cast("string"))).alias("area_unit"),
    )
    return source_profile(rows, F.col("sector") != "O", "sector", "organization", "operation", "row")


def histogram_sql(source: str, bins: int) -> str:
    return f"""v AS (SELECT v FROM ({source}) WHERE v >= 0),
      s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n, max(v) OVER () AS m FROM v),
      c AS (SELECT max(v) AS ceiling, max(m) AS m FROM s WHERE i = floor(0.99::DOUBLE * (n - 1))),
      b AS (SELECT CASE WHEN v > ceiling THEN {bins} ELSE least({bins} - 1, CAST(floor(v / (ceiling / {bins})) AS BIGINT)) END AS bin, count(*) AS n FROM v, c GROUP BY ALL),
      g AS (SELECT CAST(range AS BIGINT) AS bin FROM range({bins + 1}))
      SELECT bin, round(CASE WHEN bin = {bins} THEN ceiling ELSE bin * (ceiling / {bins}) END, 6) AS "from", round(CASE WHEN bin = {bins} THEN m ELSE (bin + 1) * (ceiling / {bins}) END, 6) AS "to",
        coalesce(n, 0) AS count, bin = {bins} AS open_ended FROM g LEFT JOIN b USING (bin), c WHERE bin < {bins} OR n > 0"""


@query("ag15_histogram", VW + ", " + histogram_sql("SELECT eui AS v FROM entity_years", 24))
def _(t):
    bins = R.equal_width_bins(_stored_entities(t), [], F.col("eui"))
    return bins.withColumn("from", r("from")).withColumn("to", r("to"))


@query("ag17_filter_options", VW + " SELECT DISTINCT region FROM schools WHERE region IS NOT NULL ORDER BY region")
def _(t):
    from peerscope.plans.reads import distinct_options

    return distinct_options(V.schools(t), "region")


@query(
    "ag18_city_rollup",
    VW + " SELECT lower(city) AS city_key, arg_min(city, name || slug) AS label, count(*) AS schools FROM schools GROUP BY ALL",
)
def _(t):
    from peerscope.functions.text import normalize_query

    return V.schools(t).groupBy(normalize_query(F.col("city")).alias("city_key")).agg(
        F.min_by("city", F.struct("name", "slug")).alias("label"), F.count("*").alias("schools")
    )


# ---- statistics ---------------------------------------------------------------------------------

_BY_BRAND = "SELECT p_brand, count(*) AS n, round(quantile_cont(l_extendedprice, {q}), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def _prices(t):
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_extendedprice")


@query(
    "st1_quantiles",
    """SELECT p_brand, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
       round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def _(t):
    q = R.exact_quantiles(_prices(t), ["p_brand"], F.col("l_extendedprice"), {"q10": 0.1, "q25": 0.25, "q95": 0.95})
    return q.select("p_brand", "n", r("q10", 4).alias("q10"), r("q25", 4).alias("q25"), r("q95", 4).alias("q95"))


@query("st2_median", "SELECT p_brand, count(*) AS n, round(median(l_extendedprice), 4) AS median FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def _(t):
    q = R.exact_quantiles(_prices(t), ["p_brand"], F.col("l_extendedprice"), {"median": 0.5})
    return q.select("p_brand", "n", r("median", 4).alias("median"))


@query(
    "st3_percentile_rank",
    VW + """, g AS (SELECT reporting_year, category AS operation_category, eui, entity_key FROM entity_years WHERE eui IS NOT NULL),
      k AS (SELECT *, rank() OVER (PARTITION BY reporting_year, operation_category ORDER BY eui) - 1 AS below, count(*) OVER (PARTITION BY reporting_year, operation_category, eui) AS ties,
            count(*) OVER (PARTITION BY reporting_year, operation_category) AS n FROM g)
      SELECT entity_key, reporting_year, round(100 * (below + 0.5 * (ties - 1)) / nullif(n - 1, 0), 6) AS percentile FROM k""",
)
def _(t):
    keys = ["reporting_year", "operation_category"]
    rows = _stored_entities(t).filter("eui is not null")
    ranks = R.group_percentile_ranks(rows, keys, F.col("eui")).withColumnRenamed("value", "eui")
    return rows.join(ranks, [*keys, "eui"]).select("entity_key", "reporting_year", r("percentile").alias("percentile"))


_MAD_SQL = """m AS (SELECT p_brand, median(l_extendedprice) AS med FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  d AS (SELECT p_brand, any_value(med) AS med, median(abs(l_extendedprice - med)) AS mad, avg(abs(l_extendedprice - med)) AS mean_ad
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN m USING (p_brand) GROUP BY ALL)"""


@query("st4_mad", f"WITH {_MAD_SQL} SELECT p_brand, round(med, 4) AS median, round(mad, 4) AS mad, round(mean_ad, 4) AS mean_ad FROM d")
def _(t):
    m = R.exact_mad(_prices(t), ["p_brand"], F.col("l_extendedprice"))
    return m.select("p_brand", r("median", 4).alias("median"), r("mad", 4).alias("mad"), r("mean_ad", 4).alias("mean_ad"))


@query(
    "st5_robust_z",
    f"""WITH {_MAD_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(0.6745::DOUBLE * (l_extendedprice - med) / mad, 6) AS z
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN d USING (p_brand)""",
)
def _(t):
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    m = R.exact_mad(lines, ["p_brand"], F.col("l_extendedprice"))
    z = S.robust_z(F.col("l_extendedprice"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return lines.join(m, "p_brand").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(z).alias("z"))


_SUPPLIER_YEARS = "SELECT l_suppkey, year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL"


def _supplier_years(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum(price).cast("double").alias("value"))


@query("st6_linear_slope", f"SELECT l_suppkey, count(*) AS points, round(regr_slope(value, year), 5) AS slope FROM ({_SUPPLIER_YEARS}) GROUP BY ALL")
def _(t):
    points = F.array_sort(F.collect_list(F.struct(F.col("year").alias("x"), F.col("value").alias("y"))))  # one point a year
    s = _supplier_years(t).groupBy("l_suppkey").agg(points.alias("p"))
    return s.select("l_suppkey", F.size("p").alias("points"), r(S.linear_slope(F.col("p")), 5).alias("slope"))


@query(
    "st7_anomaly_label",
    f"""WITH {_MAD_SQL}, z AS (SELECT p_brand, 0.6745::DOUBLE * (l_extendedprice - med) / mad AS z FROM lineitem JOIN part ON l_partkey = p_partkey JOIN d USING (p_brand))
        SELECT p_brand, CASE WHEN z >= 3.5 THEN 'unusually_high' WHEN z >= 2 THEN 'elevated' ELSE 'typical' END AS label, count(*) AS n FROM z GROUP BY ALL""",
)
def _(t):
    rows = _prices(t)
    m = R.exact_mad(rows, ["p_brand"], F.col("l_extendedprice"))
    z = S.robust_z(F.col("l_extendedprice"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return rows.join(m, "p_brand").groupBy("p_brand", S.anomaly_label(z).alias("label")).agg(F.count("*").alias("n"))


@query(
    "st10_bands",
    VW + """, c AS (SELECT quantile_cont(eui, 1/3) AS a, quantile_cont(eui, 2/3) AS b, least(0, min(eui)) AS lo, greatest(100, max(eui)) AS hi FROM entity_years WHERE eui IS NOT NULL)
      SELECT 'low' AS tone, round(lo, 6) AS "min", round(a, 6) AS "max" FROM c UNION ALL SELECT 'mid', round(a, 6), round(b, 6) FROM c UNION ALL SELECT 'high', round(b, 6), round(hi, 6) FROM c""",
)
def _(t):
    from peerscope.plans.reads import bands

    got = bands(_stored_entities(t), "eui", F.col("eui"))
    return got.select("tone", r("min").alias("min"), r("max").alias("max"))


# ---- windows ------------------------------------------------------------------------------------

_PER_ENTITY = """p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY year DESC) AS rn FROM ({0}) WHERE year NOT IN (1998, 1999) AND value > 0)"""


@query(
    "wn1_recent_trend",
    "WITH " + _PER_ENTITY.format(_SUPPLIER_YEARS) + """ SELECT l_suppkey, round(regr_slope(value, year) / avg(value) * 100, 6) AS trend_pct,
      array_to_string(list(year ORDER BY year), '|') AS trend_years FROM p WHERE rn <= 5 GROUP BY ALL HAVING count(*) >= 3""",
)
def _(t):
    got = trend_per_entity(_supplier_years(t), "l_suppkey", pandemic_years=V.DISRUPTED_YEARS).filter("trend_pct is not null")
    return got.select("l_suppkey", r("trend_pct").alias("trend_pct"), joined("trend_years").alias("trend_years"))


@query(
    "wn2_trend_as_known",
    V.PEERS_SQL + """ SELECT e.entity_key, e.reporting_year, round(t.trend_pct, 6) AS trend_pct, array_to_string(coalesce(t.trend_years, []), '|') AS trend_years
      FROM entity_years e LEFT JOIN trends t USING (entity_key, reporting_year) WHERE e.eui IS NOT NULL""",
)
def _(t):
    got = trend_as_known(
        _entities(t), "entity_key", "reporting_year", "eui", U.usable_as_peer(F.col("quality_flags")), pandemic_years=V.DISRUPTED_YEARS
    )
    return got.filter("eui is not null").select("entity_key", "reporting_year", r("trend_pct").alias("trend_pct"), joined("trend_years").alias("trend_years"))


@query(
    "wn3_year_over_year",
    VW + """, v AS (SELECT entity_key, reporting_year AS year, eui, lag(reporting_year) OVER w AS py, lag(eui) OVER w AS pv FROM entity_years WHERE eui > 0 WINDOW w AS (PARTITION BY entity_key ORDER BY reporting_year))
      SELECT entity_key, year, py AS previous_year, round((eui - pv) / pv * 100, 6) AS change_pct, abs((eui - pv) / pv) > 0.3 AS large,
        year IN (1998, 1999) OR py IN (1998, 1999) AS pandemic_affected FROM v WHERE year = py + 1""",
)
def _(t):
    rows = _entities(t).select("entity_key", F.col("reporting_year").alias("year"), F.col("eui").alias("value"))
    got = E.year_over_year(rows, "entity_key", pandemic_years=V.DISRUPTED_YEARS)
    return got.withColumn("change_pct", r("change_pct"))


@query(
    "wn4_year_gaps",
    VW + """, s AS (SELECT entity_key, unnest(range(min(reporting_year), max(reporting_year) + 1)) AS year FROM entity_years GROUP BY entity_key)
      SELECT s.entity_key, s.year, e.entity_key IS NULL AS missing, round(eui, 9) AS eui FROM s LEFT JOIN entity_years e ON s.entity_key = e.entity_key AND s.year = e.reporting_year""",
)
def _(t):
    rows = _entities(t).select("entity_key", F.col("reporting_year").alias("year"), "eui")
    return E.with_year_gaps(rows, "entity_key").select("entity_key", "year", "missing", r("eui", 9).alias("eui"))


@query(
    "wn5_latest_year",
    VW + """ SELECT entity_key, max(reporting_year) AS latest_year, (SELECT max(reporting_year) FROM entity_years) AS overall,
       round(arg_max(coalesce(eui, -1), reporting_year), 9) AS latest_eui FROM entity_years GROUP BY entity_key""",
)
def _(t):
    rows = _entities(t)
    newest = rows.groupBy("entity_key").agg(
        F.max("reporting_year").alias("latest_year"), r(F.max_by(F.coalesce("eui", F.lit(-1.0)), "reporting_year"), 9).alias("latest_eui")
    )
    return newest.join(F.broadcast(rows.agg(F.max("reporting_year").alias("overall"))), F.lit(True))  # one row


@query(
    "wn6_first_and_last_per_key",
    "SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, count(*) AS turns FROM conversations GROUP BY ALL",
)
def _(t):
    return t.conversations.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"), F.count("*").alias("turns")
    )

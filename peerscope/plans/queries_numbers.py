"""Numbers, units, intensities, flags, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerscope.functions import units as U
from peerscope.operators.quantities import convert_quantities
from peerscope.operators.score import data_confidence, opportunity_score
from peerscope.plans import views as V
from peerscope.plans.registry import joined, query, r

VW = V.VIEWS_SQL


def _priced(t):
    """Line items with the price written as a person would, and unit labels."""
    price = F.col("l_extendedprice")
    text = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("$"), F.format_number(price.cast("decimal(18,2)"), 2)))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit(" "), F.format_number(price.cast("decimal(18,2)"), 2)))
        .when(F.col("l_linenumber") % 4 == 2, price.cast("decimal(18,2)").cast("string"))
        .otherwise(F.when(F.col("l_returnflag") == "R", "Not Available").otherwise("12f"))
    )
    return t.lineitem.withColumn("written", text)


_LINE = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("nu1_to_float", f"SELECT {_LINE}, CASE WHEN l_linenumber % 4 <> 3 THEN l_extendedprice END AS amount FROM lineitem")
def _(t):
    return _priced(t).select(*_KEYS, U.to_float(F.col("written")).alias("amount"))


@query(
    "nu2_convert_quantity",
    f"""SELECT {_LINE}, CASE l_returnflag WHEN 'A' THEN l_quantity * 0.09290304::DOUBLE WHEN 'N' THEN l_quantity END AS value,
              l_returnflag <> 'R' AS recognized FROM lineitem""",
)
def _(t):
    unit = F.when(F.col("l_returnflag") == "A", "Square feet").when(F.col("l_returnflag") == "N", "Mètres carrés").otherwise("Hectares")
    return convert_quantities(t.lineitem, F.col("l_quantity").cast("string"), unit, U.AREA_TO_M2).select(*_KEYS, "value", "recognized")


@query(
    "nu3_gas_quantities",
    f"""SELECT {_LINE}, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS m3,
              CASE WHEN l_returnflag = 'N' THEN l_quantity END AS gj, l_returnflag <> 'R' AS recognized FROM lineitem""",
)
def _(t):
    unit = F.when(F.col("l_returnflag") == "A", "Cubic Meter").when(F.col("l_returnflag") == "N", "Giga Joule").otherwise("therms")
    got = U.gas_quantities(F.lit(None).cast("double"), F.col("l_quantity").cast("string"), unit)
    return t.lineitem.select(*_KEYS, got.alias("q")).select(*_KEYS, "q.*")


@query(
    "nu4_field_priority",
    VW + """ SELECT facility_id, reporting_year, coalesce(natural_gas_m3, electricity_kwh) AS first_reported,
             coalesce(natural_gas_m3, electricity_kwh * 0.0036::DOUBLE) AS gj FROM energy""",
)
def _(t):
    e = V.energy_records(t)
    return e.select(
        "facility_id",
        "reporting_year",
        F.coalesce("natural_gas_m3", "electricity_kwh").alias("first_reported"),
        F.coalesce(F.col("natural_gas_m3"), F.col("electricity_kwh") * U.GJ_PER_KWH).alias("gj"),
    )


@query(
    "nu5_reported_sum",
    VW + """ SELECT facility_id, reporting_year, CASE WHEN coalesce(electricity_gj, natural_gas_gj, natural_gas_m3) IS NOT NULL THEN
             round(coalesce(electricity_gj, 0) + coalesce(natural_gas_gj, 0) + coalesce(natural_gas_m3, 0), 8) END AS total FROM energy""",
)
def _(t):
    total = U.reported_sum([F.col("electricity_gj"), F.col("natural_gas_gj"), F.col("natural_gas_m3")])
    return V.energy_records(t).select("facility_id", "reporting_year", r(total, 8).alias("total"))


@query(
    "nu6_total_recovery",
    VW + """ SELECT facility_id, reporting_year, round(CASE WHEN total_site_energy_gj IS NOT NULL THEN total_site_energy_gj
               WHEN floor_area_m2 > 0 THEN 0.7::DOUBLE * floor_area_m2 END, 6) AS total, total_site_energy_gj IS NULL AND coalesce(floor_area_m2 > 0, false) AS derived FROM energy""",
)
def _(t):
    from peerscope.plans.ingest import recovered_total

    got = recovered_total(F.col("total_site_energy_gj"), F.lit(0.7), F.col("floor_area_m2"))
    return V.energy_records(t).select("facility_id", "reporting_year", got.alias("g")).select(
        "facility_id", "reporting_year", r("g.total").alias("total"), F.col("g.derived").alias("derived")
    )


@query(
    "nu7_slot_value",
    f"""SELECT {_LINE}, CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN l_returnflag = 'N' THEN l_tax END AS hours FROM lineitem""",
)
def _(t):
    flag = F.col("l_returnflag")
    slots = [
        (F.when(flag == "A", "Weekly Average Hours").otherwise("Number of Portables"), F.col("l_quantity").cast("string")),
        (F.when(flag == "N", "weekly average hours").otherwise("Site"), F.col("l_tax").cast("string")),
        (F.lit("Weekly Average Hours"), F.lit("unknown")),
    ]
    return t.lineitem.select(*_KEYS, U.slot_value(slots, "weekly average hours").alias("hours"))


@query("nu8_whole_number", "SELECT s_suppkey, CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(s_acctbal AS BIGINT) END AS whole, CAST(s_suppkey AS BIGINT) AS same FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", U.whole_number(F.col("s_acctbal")).alias("whole"), U.whole_number(F.col("s_suppkey").cast("double")).alias("same"))


@query(
    "nu9_intensities",
    VW + """ SELECT facility_id, reporting_year,
        round(CASE WHEN total_site_energy_gj >= 0 AND floor_area_m2 > 0 THEN total_site_energy_gj / floor_area_m2 END, 9) AS eui,
        round(CASE WHEN ghg_kg_co2e >= 0 AND floor_area_m2 > 0 THEN ghg_kg_co2e / floor_area_m2 END, 9) AS ghg_intensity,
        round(CASE WHEN electricity_kwh >= 0 AND floor_area_m2 > 0 THEN electricity_kwh / floor_area_m2 END, 9) AS electricity_intensity,
        round(CASE WHEN natural_gas_gj >= 0 AND floor_area_m2 > 0 THEN natural_gas_gj / floor_area_m2 END, 9) AS gas_intensity FROM energy""",
)
def _(t):
    area = F.col("floor_area_m2")
    return V.energy_records(t).select(
        "facility_id",
        "reporting_year",
        r(U.per_area(F.col("total_site_energy_gj"), area), 9).alias("eui"),
        r(U.per_area(F.col("ghg_kg_co2e"), area), 9).alias("ghg_intensity"),
        r(U.per_area(F.col("electricity_kwh"), area), 9).alias("electricity_intensity"),
        r(U.per_area(F.col("natural_gas_gj"), area), 9).alias("gas_intensity"),
    )


@query("nu10_kwh_equivalent", VW + " SELECT facility_id, reporting_year, round(total_site_energy_gj * (1000 / 3.6::DOUBLE), 3) AS ekwh FROM energy")
def _(t):
    return V.energy_records(t).select("facility_id", "reporting_year", r(U.kwh_equivalent(F.col("total_site_energy_gj")), 3).alias("ekwh"))


@query(
    "nu11_gap_to_median",
    VW + """, m AS (SELECT reporting_year, category, median(eui) AS med FROM entity_years GROUP BY ALL)
        SELECT entity_key, reporting_year, round(CASE WHEN eui IS NOT NULL AND floor_area_m2 > 0 THEN greatest(0, eui - med) * floor_area_m2 END, 4) AS gap
        FROM entity_years JOIN m USING (reporting_year, category)""",
)
def _(t):
    from peerscope.operators.entities import combine_entity_years
    from peerscope.operators.ranking import exact_quantiles, join_null_safe

    keys = ["reporting_year", "operation_category"]
    e = combine_entity_years(V.facility_years(t))
    medians = exact_quantiles(e, keys, F.col("eui"), {"med": 0.5}).drop("n")
    return join_null_safe(e, medians, keys).select(
        "entity_key", "reporting_year", r(U.gap_to_median(F.col("eui"), F.col("med"), F.col("floor_area_m2")), 4).alias("gap")
    )


@query(
    "nu12_coordinates",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND 40 + (c_custkey % 20) BETWEEN 41.5 AND 57 THEN CAST(40 + c_custkey % 20 AS DOUBLE) END AS latitude,
              CASE WHEN c_custkey % 3 <> 0 AND 40 + (c_custkey % 20) BETWEEN 41.5 AND 57 THEN -80.25::DOUBLE END AS longitude FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    point = U.coordinates((40 + key % 20).cast("string"), F.when(key % 3 == 0, "80.25").otherwise(" -80.25 "))
    return t.customer.select(key, point.alias("p")).select("c_custkey", "p.latitude", "p.longitude")


@query("nu13_trend_factor", "SELECT s_suppkey, round(least(1, greatest(0, (s_acctbal / 500 + 10) / 20)), 9) AS factor FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", r(U.trend_factor(F.col("s_acctbal") / 500), 9).alias("factor"))


# ---- filters ------------------------------------------------------------------------------------


@query(
    "fl1_school_board_rows",
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 2",
)
def _(t):
    from peerscope.plans.ingest import is_school_board
    from peerscope.plans.queries_text import organizations

    rows = organizations(t)
    return rows.filter(is_school_board(F.lit(None).cast("string"), F.col("organization_name"), F.lit(False))).select("c_custkey", "n_name")


@query(
    "fl2_required_fields",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_organization_or_facility_name' WHEN o_orderkey % 7 = 0 THEN 'unknown_reporting_year' END AS reason FROM orders",
)
def _(t):
    from peerscope.plans.ingest import energy_rejection

    key = F.col("o_orderkey")
    reason = energy_rejection(F.when(key % 5 != 0, F.lit("Board")), F.lit("School"), F.when(key % 7 != 0, F.year("o_orderdate")))
    return t.orders.select(key, reason.alias("reason"))


@query("fl3_plausible_records", VW + " SELECT facility_id, reporting_year FROM energy WHERE NOT list_contains(flags, 'implausible_intensity')")
def _(t):
    return V.energy_records(t).filter(U.plausible(F.col("data_quality_flags"))).select("facility_id", "reporting_year")


@query("fl4_usable_as_peer", VW + " SELECT entity_key, reporting_year FROM entity_years WHERE usable")
def _(t):
    from peerscope.operators.entities import combine_entity_years

    return combine_entity_years(V.facility_years(t)).filter(U.usable_as_peer(F.col("quality_flags"))).select("entity_key", "reporting_year")


@query(
    "fl6_table_filters",
    VW + " SELECT slug, name FROM schools WHERE contains(lower(name), 'ab') AND school_level = 'elementary' AND contains(lower(city), 'uild')",
)
def _(t):
    from peerscope.plans.reads import school_filters

    return V.schools(t).filter(school_filters(q="AB", level="elementary", city_contains="Uild")).select("slug", "name")


# ---- quality flags, scores ----------------------------------------------------------------------


@query("sc1_quality_flags", VW + " SELECT facility_id, reporting_year, array_to_string(flags, '|') AS flags FROM energy")
def _(t):
    return V.energy_records(t).select("facility_id", "reporting_year", joined("data_quality_flags").alias("flags"))


@query(
    "sc2_measure_flags",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([
          CASE WHEN l_returnflag = 'R' THEN 'unrecognized_unit:floor_area' END, CASE WHEN l_linestatus = 'F' THEN 'unrecognized_unit:electricity' END,
          CASE WHEN l_returnflag <> 'R' THEN 'total_energy_derived_from_reported_intensity' END], lambda x: x IS NOT NULL), '|') AS flags FROM lineitem""",
)
def _(t):
    from peerscope.plans.ingest import measures

    none = F.lit(None).cast("string")
    cells = {
        "floor_area_quantity": (F.col("l_quantity") + 1).cast("string"),
        "floor_area_unit": F.when(F.col("l_returnflag") == "R", "Hectares").otherwise("m2"),
        "electricity_quantity": F.lit("12"),
        "electricity_unit": F.when(F.col("l_linestatus") == "F", "BTU").otherwise("kWh"),
        "reported_eui_gj_m2": F.lit("0.5"),
    }
    got = measures(lambda name: cells.get(name, none))
    return t.lineitem.select(*_KEYS, joined(got["flags"]).alias("flags"))


@query(
    "sc3_opportunity_score",
    VW + """, p AS (SELECT entity_key, reporting_year, facility_id, school_id, reporting_year AS y, flags, match_confidence,
          CASE WHEN eui IS NOT NULL THEN (floor_area_m2 * 7) % 100 END AS pct, CAST(floor(floor_area_m2) AS BIGINT) % 40 AS n,
          CASE WHEN facility_count = 1 THEN (floor_area_m2 % 30) - 15 END AS tr,
          list_filter(flags, lambda x: x IN ('implausible_intensity', 'negative_energy_value', 'duplicate_facility_year', 'nonpositive_floor_area')
             OR starts_with(x, 'unrecognized_unit')) AS blocking FROM entity_years WHERE floor_area_m2 > 0),
       q AS (SELECT *, pct IS NULL OR n < 10 AS short, len(blocking) > 0 AS blocked,
          CASE WHEN tr IS NOT NULL THEN pct / 100 * 0.8::DOUBLE + least(1, greatest(0, (tr + 10) / 20)) * 0.2::DOUBLE ELSE pct / 100 END AS raw,
          coalesce(match_confidence >= 0.95, false) AS ok, list_contains(flags, 'missing_total_energy') OR list_contains(flags, 'missing_floor_area') AS inc FROM p),
       s AS (SELECT *, (CASE WHEN n >= 20 THEN 2 ELSE 1 END) + (CASE WHEN tr IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN ok THEN 1 ELSE 0 END) - (CASE WHEN inc THEN 1 ELSE 0 END) AS pts FROM q)
       SELECT entity_key, reporting_year, short OR blocked AS suppressed,
          CASE WHEN NOT (short OR blocked) THEN CAST(floor(raw * 100 + 0.5) AS BIGINT) END AS score,
          CASE WHEN NOT (short OR blocked) THEN CASE WHEN pts >= 5 THEN 'High' WHEN pts >= 3 THEN 'Medium' ELSE 'Low' END END AS confidence,
          CASE WHEN short THEN 'Insufficient comparable facilities for a reliable peer benchmark.'
               WHEN blocked THEN 'Data quality issues prevent a reliable score (' || array_to_string(blocking, ', ') || ').'
               ELSE array_to_string(list_filter([CASE WHEN n >= 20 THEN n || ' comparable facilities (20+ preferred).' ELSE 'Only ' || n || ' comparable facilities (20+ preferred).' END,
                 CASE WHEN tr IS NOT NULL THEN 'Trend based on 3 reporting years.' ELSE 'Fewer than 3 usable years: score uses peer percentile only.' END,
                 CASE WHEN NOT ok THEN 'Facility-to-school match is not fully confirmed.' END, CASE WHEN inc THEN 'Some reported fields are missing.' END], lambda x: x IS NOT NULL), '|') END AS reasons
       FROM s""",
)
def _(t):
    from peerscope.operators.entities import combine_entity_years

    e = combine_entity_years(V.facility_years(t)).filter("floor_area_m2 > 0")
    area = F.col("floor_area_m2")
    got = opportunity_score(
        F.when(F.col("eui").isNotNull(), (area * 7) % 100),
        F.floor(area).cast("long") % 40,
        F.when(F.col("facility_count") == 1, (area % 30) - 15),
        F.array(F.lit(2017), F.lit(2018), F.lit(2019)),
        F.col("match_confidence"),
        F.col("quality_flags"),
    )
    return e.select("entity_key", "reporting_year", got.alias("s")).select(
        "entity_key", "reporting_year", "s.suppressed", "s.score", "s.confidence", joined("s.reasons").alias("reasons")
    )


@query(
    "sc5_data_confidence",
    VW + """, x AS (SELECT facility_id, reporting_year, flags, floor_area_m2, total_site_energy_gj, f.match_confidence, f.match_method, facility_id % 30 AS peers,
          facility_id % 6 AS yrs, facility_id % 3 <> 0 AS located, facility_id % 9 = 0 AS jump FROM energy JOIN facilities f USING (facility_id)),
       y AS (SELECT *, list_filter([
          CASE WHEN match_confidence IS NULL THEN 'limiting' WHEN match_confidence < 0.95 THEN 'caution' WHEN match_method = 'override' THEN 'info' END,
          CASE WHEN floor_area_m2 IS NULL OR list_contains(flags, 'nonpositive_floor_area') THEN 'limiting' END,
          CASE WHEN total_site_energy_gj IS NULL THEN 'limiting' END,
          CASE WHEN list_contains(flags, 'negative_energy_value') THEN 'limiting' END,
          CASE WHEN list_contains(flags, 'implausible_intensity') THEN 'limiting' END,
          CASE WHEN list_contains(flags, 'duplicate_facility_year') THEN 'caution' END,
          CASE WHEN len(list_filter(flags, lambda v: starts_with(v, 'unrecognized_unit'))) > 0 THEN 'limiting' END,
          CASE WHEN list_contains(flags, 'total_energy_derived_from_reported_intensity') THEN 'info' END,
          CASE WHEN peers < 10 THEN 'limiting' WHEN peers < 20 THEN 'caution' END,
          CASE WHEN yrs < 3 THEN 'caution' END, CASE WHEN jump THEN 'caution' END, CASE WHEN NOT located THEN 'info' END], lambda v: v IS NOT NULL) AS sev FROM x)
       SELECT facility_id, reporting_year, CASE WHEN list_contains(sev, 'limiting') THEN 'Low' WHEN list_contains(sev, 'caution') THEN 'Medium' ELSE 'High' END AS level,
          array_to_string(sev, '|') AS severities FROM y""",
)
def _(t):
    rows = V.energy_records(t).join(V.facilities(t).select("facility_id", "match_confidence", "match_method"), "facility_id")
    key = F.col("facility_id")
    latest = F.struct(
        "floor_area_m2",
        "total_site_energy_gj",
        F.lit(1).alias("facility_count"),
        F.array_contains("data_quality_flags", "total_energy_derived_from_reported_intensity").alias("total_derived"),
        F.col("data_quality_flags").alias("quality_flags"),
    )
    got = data_confidence(
        F.col("match_confidence"), F.array(F.coalesce("match_method", F.lit(""))), latest, key % 6, key % 30, key % 3 != 0, key % 9 == 0
    )
    return rows.select("facility_id", "reporting_year", got.alias("c")).select(
        "facility_id", "reporting_year", "c.level", joined(F.transform("c.reasons", lambda x: x["severity"])).alias("severities")
    )

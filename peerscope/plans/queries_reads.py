"""Benchmark end to end, cohorts, profiles, read models, paging, set operations, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerscope.functions import units as U
from peerscope.operators import checks as K
from peerscope.operators import entities as E
from peerscope.operators.bands import COUNTS, stage_counts
from peerscope.operators.cohort import STAGES, peer_histograms, peer_statistics, stage_label
from peerscope.plans import benchmark as B
from peerscope.plans import profile as P
from peerscope.plans import reads as D
from peerscope.plans import views as V
from peerscope.plans.queries_groups import YEARLY_SQL
from peerscope.plans.registry import joined, query, r
from peerscope.session import materialize

VW, PM = V.VIEWS_SQL, V.PEERS_SQL
YEAR = 2001
STAGE_SQL = "CASE stage " + " ".join(f"WHEN {i} THEN '{label}'" for i, (label, _, _) in enumerate(STAGES)) + " END"


def _metrics(t):
    """The result table as production keeps it: written once, then read by the read models."""
    return materialize(B.peer_metrics(V.facility_years(t), V.DISRUPTED_YEARS))


def _stored_entities(t):
    return materialize(E.combine_entity_years(V.facility_years(t)))


def _statistics(t):
    entities = _stored_entities(t)
    return entities, peer_statistics(entities, U.usable_as_peer(F.col("quality_flags")))


def _stage_counts(t):
    return stage_counts(_stored_entities(t), U.usable_as_peer(F.col("quality_flags")))


@query(
    "jn12_peer_candidates",
    PM + """, n AS (SELECT entity_key, reporting_year, count(*) FILTER (stage = 0) AS n0, count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage = 2) AS n2,
        count(*) FILTER (stage = 3) AS n3, count(*) FILTER (stage = 4) AS n4 FROM staged WHERE fits GROUP BY ALL)
      SELECT entity_key, reporting_year, CASE WHEN weekly_hours > 0 THEN coalesce(n0, 0) END AS stage0_peers, coalesce(n1, 0) AS stage1_peers, coalesce(n2, 0) AS stage2_peers,
        coalesce(n3, 0) AS stage3_peers, coalesce(n4, 0) AS stage4_peers FROM entity_years LEFT JOIN n USING (entity_key, reporting_year) WHERE eui IS NOT NULL""",
)
def _(t):
    return _stage_counts(t).select("entity_key", "reporting_year", *COUNTS)


@query(
    "st8_select_peers",
    PM + f" SELECT entity_key, reporting_year, {STAGE_SQL} AS peer_stage, peer_count FROM peer_metrics WHERE eui IS NOT NULL",
)
def _(t):
    return _stage_counts(t).select("entity_key", "reporting_year", stage_label(F.col("peer_stage")).alias("peer_stage"), "peer_count")


@query(
    "st9_cohort_statistics",
    PM + """ SELECT entity_key, reporting_year, round(med, 9) AS med, round(q25, 9) AS q25, round(q75, 9) AS q75, round(eui_percentile, 6) AS eui_percentile,
      round(ghg_percentile, 6) AS ghg_percentile, round(z, 6) AS z FROM peer_metrics WHERE eui IS NOT NULL""",
)
def _(t):
    _, s = _statistics(t)
    return s.select(
        "entity_key", "reporting_year", r("peer_median_eui", 9).alias("med"), r("peer_q25_eui", 9).alias("q25"), r("peer_q75_eui", 9).alias("q75"),
        r("eui_percentile").alias("eui_percentile"), r("ghg_percentile").alias("ghg_percentile"), r("eui_robust_z").alias("z"),
    )


@query(
    "ag16_peer_histograms",
    PM + """, u AS (SELECT entity_key, reporting_year, peer_eui AS v, own FROM peers JOIN (SELECT entity_key, reporting_year, eui AS own FROM entity_years) USING (entity_key, reporting_year)
        UNION ALL SELECT c.entity_key, c.reporting_year, e.eui, e.eui FROM chosen c JOIN entity_years e USING (entity_key, reporting_year)),
      s AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity_key, reporting_year) AS n, max(v) OVER (PARTITION BY entity_key, reporting_year) AS m FROM u WINDOW w AS (PARTITION BY entity_key, reporting_year ORDER BY v)),
      c AS (SELECT entity_key, reporting_year, max(v) AS ceiling, any_value(m) AS m, any_value(own) AS own, any_value(n) AS n FROM s WHERE i = floor(0.99::DOUBLE * (n - 1)) GROUP BY ALL),
      b AS (SELECT entity_key, reporting_year, CASE WHEN v > ceiling THEN 18 WHEN ceiling = 0 THEN 0 ELSE least(17, CAST(floor(v / (ceiling / 18)) AS BIGINT)) END AS bin, count(*) AS k
        FROM u JOIN c USING (entity_key, reporting_year) GROUP BY ALL),
      g AS (SELECT c.*, CAST(range AS BIGINT) AS bin, CASE WHEN range = 18 THEN ceiling ELSE range * (ceiling / 18) END AS lo, CASE WHEN range = 18 THEN m ELSE (range + 1) * (ceiling / 18) END AS hi FROM c, range(19))
      SELECT entity_key, reporting_year, bin, round(lo, 9) AS "from", round(hi, 9) AS "to", CASE WHEN ceiling = 0 THEN n ELSE coalesce(k, 0) - CASE WHEN own >= lo AND (own < hi OR bin = 18) THEN 1 ELSE 0 END END AS count,
        bin = 18 AS open_ended FROM g LEFT JOIN b USING (entity_key, reporting_year, bin) WHERE CASE WHEN ceiling = 0 THEN bin = 0 ELSE bin < 18 OR k > 0 END""",
)
def _(t):
    bins = peer_histograms(_stored_entities(t), U.usable_as_peer(F.col("quality_flags")))
    return bins.withColumn("from", r("from", 9)).withColumn("to", r("to", 9))


@query(
    "fl7_map_predicate",
    VW + f""" SELECT slug FROM schools JOIN entity_years USING (school_id) JOIN boards USING (board_number)
      WHERE reporting_year = {YEAR} AND eui IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""".replace("SELECT slug", "SELECT schools.slug"),
)
def _(t):
    metrics = _stored_entities(t).select(
        "school_id", "reporting_year", "eui", F.lit(None).cast("double").alias("eui_percentile"), F.lit(None).cast("int").alias("opportunity_score"), "ghg_intensity"
    )
    return D.map_points(V.schools(t), V.boards(t), metrics, YEAR).select("slug")


_SC4 = """ SELECT entity_key, school_id, facility_id, reporting_year, facility_count, category AS operation_category, school_level, round(eui, 9) AS eui,
    round(ghg_intensity, 9) AS ghg_intensity, round(electricity_intensity, 9) AS electricity_intensity, {stage} AS peer_stage, peer_count, round(eui_percentile, 6) AS eui_percentile, round(ghg_percentile, 6) AS ghg_percentile,
    round(med, 9) AS peer_median_eui, round(energy_gap_gj, 4) AS energy_gap_gj, round(z, 6) AS eui_robust_z, anomaly_label,
    CASE WHEN eui IS NOT NULL THEN round(trend_pct, 6) END AS trend_annual_pct,
    CASE WHEN eui IS NOT NULL THEN array_to_string(coalesce(trend_years, []), '|') ELSE '' END AS trend_years, opportunity_score, score_confidence,
    CASE WHEN eui IS NULL THEN 'Energy intensity cannot be calculated: usable floor area or total energy is missing.'
         WHEN eui_percentile IS NULL OR peer_count < 10 THEN 'Insufficient comparable facilities for a reliable peer benchmark.'
         WHEN len(blocking) > 0 THEN 'Data quality issues prevent a reliable score (' || array_to_string(blocking, ', ') || ').'
         ELSE CASE WHEN peer_count >= 20 THEN '' ELSE 'Only ' END || peer_count || ' comparable facilities (20+ preferred).' END AS first_reason,
    CASE WHEN eui IS NULL THEN '' ELSE 'Operation type: ' || category || CASE WHEN school_level IS NOT NULL THEN '|School level: ' || school_level ELSE '' END END AS criteria
  FROM peer_metrics"""


@query("sc4_peer_metrics", PM + _SC4.format(stage=STAGE_SQL))
def _(t):
    m = B.peer_metrics(V.facility_years(t), V.DISRUPTED_YEARS)
    return m.select(
        "entity_key", "school_id", "facility_id", "reporting_year", "facility_count", "operation_category", "school_level", r("eui", 9).alias("eui"),
        r("ghg_intensity", 9).alias("ghg_intensity"), r("electricity_intensity", 9).alias("electricity_intensity"), "peer_stage", "peer_count",
        r("eui_percentile").alias("eui_percentile"), r("ghg_percentile").alias("ghg_percentile"), r("peer_median_eui", 9).alias("peer_median_eui"),
        r("energy_gap_gj", 4).alias("energy_gap_gj"), r("eui_robust_z").alias("eui_robust_z"), "anomaly_label",
        r("trend_annual_pct").alias("trend_annual_pct"), joined("trend_years").alias("trend_years"), "opportunity_score", "score_confidence",
        F.element_at("score_reasons", 1).alias("first_reason"), joined("peer_criteria").alias("criteria"),
    )


def _views(t):
    series = P.yearly_series(V.energy_records(t), V.facilities(t), V.DISRUPTED_YEARS)
    return P.profile_views(V.schools(t), V.facilities(t), series, _metrics(t), V.DISRUPTED_YEARS)


PROFILE_SQL = PM + YEARLY_SQL + """,
newest AS (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY year DESC) AS rn, count(*) OVER (PARTITION BY school_id) AS n_years FROM series),
pts AS (SELECT school_id, year, eui, row_number() OVER (PARTITION BY school_id ORDER BY year DESC) AS rn FROM series WHERE eui > 0 AND year NOT IN (1998, 1999)),
t3 AS (SELECT school_id, regr_slope(eui, year) / avg(eui) * 100 AS trend3 FROM pts WHERE rn <= 3 GROUP BY ALL HAVING count(*) = 3),
t5 AS (SELECT school_id, regr_slope(eui, year) / avg(eui) * 100 AS trend5 FROM pts WHERE rn <= 5 GROUP BY ALL HAVING count(*) = 5),
chg AS (SELECT school_id, year, lag(year) OVER w AS py, (eui - lag(eui) OVER w) / lag(eui) OVER w AS change FROM series WHERE eui > 0 WINDOW w AS (PARTITION BY school_id ORDER BY year)),
fac AS (SELECT school_id, min(match_confidence) AS conf, bool_or(match_method = 'override') AS overridden FROM facilities WHERE school_id IS NOT NULL GROUP BY ALL),
met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY reporting_year DESC) AS rn FROM peer_metrics WHERE school_id IS NOT NULL) WHERE rn = 1),
prof AS (SELECT s.school_id, s.slug, s.name, s.school_level, s.city, s.board_number, n.year AS latest_year, n.n_years, n.total, n.area, n.eui, n.ghg_intensity, t3.trend3, t5.trend5, met.peer_count, met.opportunity_score,
    met.score_confidence, met.eui_percentile, met.energy_gap_gj, c.change, list_filter([
    CASE WHEN conf IS NULL THEN 'limiting' WHEN conf < 0.95 THEN 'caution' WHEN overridden THEN 'info' END,
    CASE WHEN n.year IS NOT NULL AND (n.area IS NULL OR list_contains(n.flags, 'nonpositive_floor_area')) THEN 'limiting' END,
    CASE WHEN n.year IS NOT NULL AND n.total IS NULL THEN 'limiting' END,
    CASE WHEN list_contains(n.flags, 'negative_energy_value') THEN 'limiting' END,
    CASE WHEN list_contains(n.flags, 'implausible_intensity') THEN 'limiting' END,
    CASE WHEN list_contains(n.flags, 'duplicate_facility_year') THEN 'caution' END,
    CASE WHEN len(list_filter(n.flags, lambda v: starts_with(v, 'unrecognized_unit'))) > 0 THEN 'limiting' END,
    CASE WHEN n.facility_count > 1 THEN 'info' END, CASE WHEN n.total_derived THEN 'info' END,
    CASE WHEN coalesce(met.peer_count, 0) < 10 THEN 'limiting' WHEN met.peer_count < 20 THEN 'caution' END,
    CASE WHEN coalesce(n.n_years, 0) < 3 THEN 'caution' END, CASE WHEN abs(c.change) > 0.3 THEN 'caution' END,
    CASE WHEN s.latitude IS NULL THEN 'info' END], lambda v: v IS NOT NULL) AS sev
  FROM schools s LEFT JOIN newest n ON n.school_id = s.school_id AND n.rn = 1 LEFT JOIN t3 ON t3.school_id = s.school_id LEFT JOIN t5 ON t5.school_id = s.school_id
  LEFT JOIN chg c ON c.school_id = s.school_id AND c.year = n.year AND c.py = n.year - 1 LEFT JOIN fac ON fac.school_id = s.school_id LEFT JOIN met ON met.school_id = s.school_id),
profiles AS (SELECT *, CASE WHEN list_contains(sev, 'limiting') THEN 'Low' WHEN list_contains(sev, 'caution') THEN 'Medium' ELSE 'High' END AS level FROM prof)"""


@query(
    "sc6_profile_views",
    PROFILE_SQL + """ SELECT school_id, latest_year, n_years AS years_reported, round(trend3, 6) AS trend3, round(trend5, 6) AS trend5, round(change * 100, 6) AS latest_change,
      level, array_to_string(sev, '|') AS severities, peer_count, opportunity_score FROM profiles""",
)
def _(t):
    v = _views(t)
    return v.select(
        "school_id", F.col("latest.year").alias("latest_year"), "years_reported", r("trend3_pct").alias("trend3"), r("trend5_pct").alias("trend5"),
        r("latest_change_pct").alias("latest_change"), F.col("confidence.level").alias("level"),
        joined(F.transform("confidence.reasons", lambda x: x["severity"])).alias("severities"), F.col("metric.peer_count").alias("peer_count"),
        F.col("metric.opportunity_score").alias("opportunity_score"),
    )


LIST_SQL = PM + f""", y AS (SELECT school_id, eui, eui_percentile, peer_count, opportunity_score, score_confidence FROM peer_metrics WHERE reporting_year = {YEAR} AND school_id IS NOT NULL),
  n AS (SELECT school_id, max(reporting_year) AS latest_year FROM peer_metrics WHERE school_id IS NOT NULL GROUP BY ALL),
  l AS (SELECT s.*, b.name AS board_name, b.slug AS board_slug, eui, eui_percentile, peer_count, opportunity_score, score_confidence, latest_year
        FROM schools s JOIN boards b USING (board_number) LEFT JOIN y USING (school_id) LEFT JOIN n USING (school_id))"""


def _list(t, condition=None):
    return D.school_list(V.schools(t), V.boards(t), _metrics(t), YEAR, condition)


def _shown(df):
    return df.select("slug", "name", "city", "region", "board_slug", r("eui", 9).alias("eui"), "peer_count", "opportunity_score", "score_confidence", "latest_year")


_SHOWN = "slug, name, city, region, board_slug, round(eui, 9) AS eui, peer_count, opportunity_score, score_confidence, latest_year"


@query("rp1_school_list_page", LIST_SQL + f" SELECT {_SHOWN} FROM l WHERE active ORDER BY eui DESC NULLS LAST, l.name, slug LIMIT 25 OFFSET 25")
def _(t):
    return _shown(D.page(_list(t, D.school_filters(active=True)), "eui", True, 2))


@query(
    "fl5_list_filters",
    LIST_SQL + f" SELECT {_SHOWN} FROM l WHERE active AND contains(lower(name), 'a') AND lower(city) = 'building' AND opportunity_score >= 30 AND opportunity_score <= 90 AND eui_percentile >= 10",
)
def _(t):
    condition = D.school_filters(q="Á", city="building", score=(30, 90), percentile=(10, None), reported_only=True, active=True)
    return _shown(_list(t, condition))


@query("fl5_board_and_region", LIST_SQL + f" SELECT {_SHOWN} FROM l WHERE region = (SELECT min(region) FROM schools) AND board_slug = (SELECT min(board_slug) FROM l WHERE region = (SELECT min(region) FROM schools))")
def _(t):
    rows = _list(t)
    region = V.schools(t).agg(F.min("region")).first()[0]
    board = rows.filter(F.col("region") == region).agg(F.min("board_slug")).first()[0]
    return _shown(rows.filter(D.school_filters(board=board, region=region)))


@query("lm1_page_ascending", LIST_SQL + f" SELECT {_SHOWN} FROM l ORDER BY opportunity_score ASC NULLS LAST, name, slug LIMIT 40 OFFSET 0")
def _(t):
    return _shown(D.page(_list(t), "score", False, 1, 40))


@query("lm1_deep_page", LIST_SQL + f" SELECT {_SHOWN} FROM l ORDER BY eui DESC NULLS LAST, name, slug LIMIT 30 OFFSET 240")
def _(t):
    return _shown(D.PageIndex(_list(t), "eui", True).page(9, 30))


@query("lm1_total", LIST_SQL + " SELECT count(*) AS total, count(eui) AS reported FROM l WHERE active")
def _(t):
    return _list(t, D.school_filters(active=True)).agg(F.count("*").alias("total"), F.count("eui").alias("reported"))


@query("lm3_client_sort", LIST_SQL + f" SELECT {_SHOWN} FROM l WHERE board_number = '3' ORDER BY latest_year DESC NULLS LAST, name, slug")
def _(t):
    return _shown(D.in_order(_list(t, F.col("board_number") == "3"), "year", True))


@query("lm5_latest_run", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t):
    runs = t.orders.select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("started_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return D.latest_run(runs).drop("started_at")


def _profiles(t):
    series = P.yearly_series(V.energy_records(t), V.facilities(t), V.DISRUPTED_YEARS)
    return P.school_profiles(V.schools(t), V.boards(t), V.facilities(t), series, _metrics(t))


@query(
    "rp2_school_profile",
    PM + YEARLY_SQL + """ SELECT s.slug, s.name, b.name AS board_name, b.slug AS board_slug, coalesce(f.n, 0) AS facilities, coalesce(y.n, 0) AS years, round(y.total, 4) AS total, round(y.eui, 6) AS eui,
        coalesce(m.n, 0) AS metrics, m.latest_year, m.opportunity_score, round(m.eui_percentile, 6) AS eui_percentile
      FROM schools s JOIN boards b USING (board_number) LEFT JOIN (SELECT school_id, count(*) AS n FROM facilities GROUP BY ALL) f USING (school_id)
        LEFT JOIN (SELECT school_id, count(*) AS n, sum(total) AS total, sum(eui) AS eui FROM series GROUP BY ALL) y USING (school_id)
        LEFT JOIN (SELECT school_id, count(*) AS n, max(reporting_year) AS latest_year, arg_max(opportunity_score, reporting_year) AS opportunity_score, arg_max(eui_percentile, reporting_year) AS eui_percentile
          FROM (SELECT * REPLACE (coalesce(opportunity_score, -1) AS opportunity_score, coalesce(eui_percentile, -1) AS eui_percentile) FROM peer_metrics) GROUP BY ALL) m USING (school_id)""",
)
def _(t):
    total = lambda name: F.aggregate(F.filter(F.transform("series", lambda y: y[name]), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    some = lambda name: F.when(F.exists("series", lambda y: y[name].isNotNull()), total(name))
    known = F.col("latest.reporting_year").isNotNull()
    return _profiles(t).select(
        "slug", "name", "board_name", "board_slug", F.size("facilities").alias("facilities"), F.size("series").alias("years"), r(some("total_site_energy_gj"), 4).alias("total"),
        r(some("eui"), 6).alias("eui"), F.size("metrics").alias("metrics"), F.col("latest.reporting_year").alias("latest_year"),
        F.when(known, F.coalesce("latest.opportunity_score", F.lit(-1))).alias("opportunity_score"), r(F.when(known, F.coalesce("latest.eui_percentile", F.lit(-1.0)))).alias("eui_percentile"),
    )


@query("rp2_profile_facilities", VW + " SELECT s.slug, f.facility_id, f.facility_name, f.operation_type, f.match_method, f.match_confidence FROM schools s JOIN boards USING (board_number) JOIN facilities f USING (school_id)")
def _(t):
    return _profiles(t).select("slug", F.inline("facilities"))


@query(
    "rp2_profile_history",
    PM + """ SELECT s.slug, reporting_year, peer_count, round(eui_percentile, 6) AS eui_percentile, opportunity_score, score_confidence, round(energy_gap_gj, 4) AS energy_gap_gj
      FROM schools s JOIN boards USING (board_number) JOIN peer_metrics USING (school_id)""",
)
def _(t):
    rows = _profiles(t).select("slug", F.inline("metrics"))
    return rows.select("slug", "reporting_year", "peer_count", r("eui_percentile").alias("eui_percentile"), "opportunity_score", "score_confidence", r("energy_gap_gj", 4).alias("energy_gap_gj"))


def _sql_number(x: str, digits: int = 0) -> str:
    return f"(CASE WHEN {x} < 0 THEN '−' ELSE '' END || format('{{:,.{digits}f}}', CAST(round(CAST(abs({x}) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)))"


def _sql_unit(x: str, unit: str, digits: int | None = 0) -> str:
    """A number with its unit; without digits one is shown below 100."""
    text = _sql_number(x, digits) if digits is not None else f"CASE WHEN abs({x}) < 100 THEN {_sql_number(x, 1)} ELSE {_sql_number(x)} END"
    return f"coalesce({text} || ' {unit}', '—')"


def _sql_trend(x: str) -> str:
    rounded = f"round(CAST({x} AS DECIMAL(38, 12)), 1)"
    return f"coalesce(CASE WHEN {rounded} > 0 THEN '+' WHEN {rounded} < 0 THEN '−' ELSE '' END || format('{{:,.1f}}', CAST(abs({rounded}) AS DOUBLE)) || '%/yr', '—')"


_SQL_NTH = """CAST(floor({0} + 0.5) AS BIGINT) || CASE WHEN CAST(floor({0} + 0.5) AS BIGINT) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN CAST(floor({0} + 0.5) AS BIGINT) % 10 = 1 THEN 'st'
  WHEN CAST(floor({0} + 0.5) AS BIGINT) % 10 = 2 THEN 'nd' WHEN CAST(floor({0} + 0.5) AS BIGINT) % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile'"""
#: The percentile in the operator's order of operations, share times 100: they differ in the last bit, which decides halves.
_SQL_PERCENTILE = "(round(eui_percentile * peer_count / 50) / 2 / peer_count * 100)"
_SQL_LEVEL = "CASE school_level WHEN 'elementary' THEN 'Elementary school' WHEN 'secondary' THEN 'Secondary school' WHEN 'combined' THEN 'Elementary and secondary school' ELSE coalesce(school_level, 'School level not reported') END"
#: The comparison's measures in SQL, in their order.
_COMPARED = {
    "School level": _SQL_LEVEL,
    "Latest reporting year": "coalesce(CAST(latest_year AS VARCHAR), '—')",
    "Energy Use Intensity": _sql_unit("eui", "GJ/m²", 2),
    "GHG intensity": _sql_unit("ghg_intensity", "kg CO₂e/m²", 1),
    "Peer percentile (EUI)": f"CASE WHEN peer_count >= 10 THEN coalesce({_SQL_NTH.format(_SQL_PERCENTILE)}, '—') ELSE '—' END",
    "Opportunity score": "coalesce(opportunity_score || ' (' || score_confidence || ')', '—')",
    "5-year trend": _sql_trend("trend5"),
    "Total site energy": _sql_unit("total", "GJ", None),
    "Floor area": _sql_unit("area", "m²"),
    "Data confidence": "CASE WHEN latest_year IS NOT NULL THEN level ELSE 'No energy data' END",
}
_COMPARED_SQL = PROFILE_SQL + " , compared AS (" + " UNION ALL ".join(f"SELECT slug, {i} AS row, '{label}' AS label, {text} AS value FROM profiles" for i, (label, text) in enumerate(_COMPARED.items())) + ")"


@query(
    "rp3_school_reports",
    PROFILE_SQL + """, rep AS (SELECT p.*, b.name AS board_name, CAST(floor(eui_percentile + 0.5) AS BIGINT) AS pn FROM profiles p JOIN boards b USING (board_number))
      SELECT slug, board_name || ' · ' || CASE school_level WHEN 'elementary' THEN 'Elementary school' WHEN 'secondary' THEN 'Secondary school'
          WHEN 'combined' THEN 'Elementary and secondary school' ELSE 'School level not reported' END || ' · ' || city AS subtitle,
        coalesce(CAST(latest_year AS VARCHAR), '—') AS latest_year, latest_year IS NOT NULL AS has_energy_data,
        coalesce(CASE WHEN area < 0 THEN '−' ELSE '' END || format('{:,}', CAST(round(CAST(abs(area) AS DECIMAL(18,4)), 0) AS BIGINT)) || ' m²', '—') AS floor_area,
        level AS data_confidence, opportunity_score IS NOT NULL AS scored, energy_gap_gj IS NULL AS no_gap FROM rep""",
)
def _(t):
    reports = P.school_reports(_views(t), V.boards(t))
    return reports.select(
        "slug", "subtitle", "latest_year", "has_energy_data", "floor_area", "data_confidence", (~F.col("score").startswith("Not shown")).alias("scored"),
        (F.col("gap") == "Not available for this school.").alias("no_gap"),
    )


_REPORTED = PROFILE_SQL + """, span AS (SELECT school_id, min(year) AS a, max(year) AS z FROM series GROUP BY ALL),
  rep AS (SELECT p.*, b.name AS board_name, CASE WHEN span.a IS NULL THEN '—' WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '–' || z END AS years
    FROM profiles p JOIN boards b USING (board_number) LEFT JOIN span USING (school_id))"""


@query(
    "rp3_report_texts",
    _REPORTED + f""" SELECT slug, name, board_name || ' · ' || {_SQL_LEVEL} || ' · ' || coalesce(city, '') AS subtitle, coalesce(CAST(latest_year AS VARCHAR), '—') AS latest_year, latest_year IS NOT NULL AS has_energy_data,
      {_sql_unit('total', 'GJ', None)} AS total_energy, {_sql_unit('eui', 'GJ/m²', 2)} AS eui, {_sql_unit('ghg_intensity', 'kg CO₂e/m²', 1)} AS ghg_intensity, {_sql_unit('area', 'm²')} AS floor_area,
      CASE WHEN opportunity_score IS NOT NULL THEN opportunity_score || ' / 100 — ' || score_confidence || ' confidence. ' || coalesce({_SQL_NTH.format(_SQL_PERCENTILE)}, '—') || ' for energy intensity among ' || {_sql_number('peer_count')} || ' comparable facilities.' ELSE 'Not shown' END AS score,
      years, {_sql_trend('trend3')} AS trend3, {_sql_trend('trend5')} AS trend5,
      CASE WHEN energy_gap_gj IS NULL THEN 'Not available for this school.' WHEN energy_gap_gj > 0 THEN 'Approximately ' || {_sql_unit('energy_gap_gj', 'GJ', None)} || ' per year.'
        ELSE 'Energy intensity is at or below the peer median; the modeled gap is zero.' END AS gap, level AS data_confidence FROM rep""",
)
def _(t):
    reports = P.school_reports(_views(t), V.boards(t)).drop("peer_group", "data_notes", "sources")
    return reports.withColumn("score", F.when(F.col("score").startswith("Not shown"), "Not shown").otherwise(F.col("score")))


@query("rp4_compare", _COMPARED_SQL + " SELECT slug, CAST(row AS BIGINT) AS row, label, value FROM compared")
def _(t):
    return P.comparison_values(_views(t))


@query(
    "rp4_compare_table",
    _COMPARED_SQL + """, three AS (SELECT slug, row_number() OVER (ORDER BY slug) AS nth FROM (SELECT DISTINCT slug FROM schools) ORDER BY slug LIMIT 3)
      SELECT label, max(value) FILTER (nth = 1) AS first, max(value) FILTER (nth = 2) AS second, max(value) FILTER (nth = 3) AS third FROM compared JOIN three USING (slug) GROUP BY label""",
)
def _(t):
    slugs = [row["slug"] for row in V.schools(t).select("slug").distinct().orderBy("slug").limit(3).collect()]
    wide = P.compare(_views(t), slugs)
    return wide.select("label", *[F.col(f"`{slug}`").alias(name) for slug, name in zip(slugs, ("first", "second", "third"), strict=True)])


@query(
    "rp4_compare_by_year",
    VW + YEARLY_SQL + """ SELECT y.year, round(max(y.eui) FILTER (s.slug = a), 9) AS first, round(max(y.eui) FILTER (s.slug = b), 9) AS second
      FROM series y JOIN schools s USING (school_id), (SELECT min(slug) AS a, max(slug) AS b FROM schools) WHERE s.slug IN (a, b) GROUP BY y.year""",
)
def _(t):
    schools = V.schools(t)
    a, b = schools.agg(F.min("slug"), F.max("slug")).first()
    series = P.yearly_series(V.energy_records(t), V.facilities(t), V.DISRUPTED_YEARS)
    wide = P.compare_series(series, schools, [a, b])
    return wide.select("year", r(F.col(f"`{a}`"), 9).alias("first"), r(F.col(f"`{b}`"), 9).alias("second"))


@query(
    "rp5_home_stats",
    PM + """, b AS (SELECT count(*) AS benchmarked_schools, count(DISTINCT s.board_number) AS boards, round(median(eui), 9) AS median_eui FROM peer_metrics p JOIN schools s USING (school_id)
        WHERE reporting_year = (SELECT max(reporting_year) FROM peer_metrics) AND eui IS NOT NULL),
      e AS (SELECT count(*) FILTER (reporting_year = m) AS reporting_facilities, round(sum(total_site_energy_gj) FILTER (reporting_year = m AND NOT list_contains(flags, 'implausible_intensity')), 4) AS total_energy_gj,
        min(reporting_year) AS first_year, count(DISTINCT reporting_year) AS years_of_data, any_value(m) AS latest_year FROM energy, (SELECT max(reporting_year) AS m FROM energy))
      SELECT latest_year, benchmarked_schools, boards, median_eui, reporting_facilities, total_energy_gj, first_year, years_of_data FROM b, e""",
)
def _(t):
    home = D.home_stats(V.schools(t), V.energy_records(t), _metrics(t))
    return home.withColumn("median_eui", r("median_eui", 9)).withColumn("total_energy_gj", r("total_energy_gj", 4))


@query(
    "rp6_overview_by_year",
    VW + """, m AS (SELECT reporting_year, count(*) AS schools, median(eui) AS med FROM entity_years WHERE school_id IS NOT NULL AND category = 'school' AND eui IS NOT NULL GROUP BY ALL)
      SELECT e.reporting_year AS year, count(*) AS facilities, round(sum(total_site_energy_gj) FILTER (NOT list_contains(flags, 'implausible_intensity')), 4) AS energy,
        count(*) FILTER (list_contains(flags, 'implausible_intensity')) AS excluded, any_value(schools) AS schools, round(any_value(med), 9) AS median_eui
      FROM energy e LEFT JOIN m ON e.reporting_year = m.reporting_year GROUP BY e.reporting_year""",
)
def _(t):
    o = D.overview_by_year(V.energy_records(t), _stored_entities(t))
    return o.select("year", "facilities", r("total_energy_gj", 4).alias("energy"), F.col("excluded_implausible").alias("excluded"), "schools", r("median_eui", 9).alias("median_eui"))


@query(
    "rp6_overview_by_region",
    VW + f""" SELECT s.region, count(*) AS schools, round(median(eui), 9) AS median_eui FROM entity_years e JOIN schools s USING (school_id)
      WHERE category = 'school' AND eui IS NOT NULL AND reporting_year = {YEAR} GROUP BY ALL""",
)
def _(t):
    got = D.overview_by(_stored_entities(t), YEAR, ["region"], V.schools(t))
    return got.select("region", "schools", r("median_eui", 9).alias("median_eui"))


@query(
    "rp6_overview_by_board",
    VW + f""" SELECT b.name AS board_name, b.slug AS board_slug, count(*) AS schools, round(median(eui), 9) AS median_eui FROM entity_years e JOIN schools s USING (school_id) JOIN boards b USING (board_number)
      WHERE category = 'school' AND eui IS NOT NULL AND reporting_year = {YEAR} GROUP BY ALL""",
)
def _(t):
    got = D.overview_by(_stored_entities(t), YEAR, ["board_name", "board_slug"], V.schools(t), V.boards(t))
    return got.select("board_name", "board_slug", "schools", r("median_eui", 9).alias("median_eui"))


MAP_SQL = PM + f""", pts AS (SELECT s.slug, s.name, s.city, s.region, s.school_level, b.name AS board_name, b.slug AS board_slug, latitude, longitude, eui, eui_percentile AS percentile, opportunity_score AS score, ghg_intensity
   FROM schools s JOIN boards b USING (board_number) JOIN peer_metrics p USING (school_id) WHERE reporting_year = {YEAR} AND latitude IS NOT NULL AND longitude IS NOT NULL AND eui IS NOT NULL)"""


@query(
    "rp7_map_points",
    MAP_SQL + " SELECT slug, region, school_level, board_slug, latitude, longitude, round(eui, 9) AS eui, round(percentile, 6) AS percentile, score, round(ghg_intensity, 9) AS ghg_intensity FROM pts",
)
def _(t):
    p = D.map_points(V.schools(t), V.boards(t), _metrics(t), YEAR)
    return p.select(
        "slug", "region", "school_level", "board_slug", "latitude", "longitude", r("eui", 9).alias("eui"), r("percentile").alias("percentile"), "score",
        r("ghg_intensity", 9).alias("ghg_intensity"),
    )


@query(
    "rp7_map_features",
    MAP_SQL + " SELECT slug, longitude AS x, latitude AS y, coalesce(score, -1)::DOUBLE AS value FROM pts",
)
def _(t):
    features = D.geojson_features(D.map_points(V.schools(t), V.boards(t), _metrics(t), YEAR), "score")
    shape = "struct<geometry:struct<coordinates:array<double>>,properties:struct<value:double>>"
    parsed = features.select("slug", F.from_json("feature", shape).alias("f"))
    return parsed.select("slug", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), F.col("f.properties.value").alias("value"))


@query(
    "rp8_board_profiles",
    LIST_SQL + f""", c AS (SELECT board_number, count(*) AS schools, count(eui) AS benchmarked FROM l WHERE active GROUP BY ALL),
      m AS (SELECT s.board_number, median(eui) AS med, median(opportunity_score) AS sc FROM peer_metrics p JOIN schools s USING (school_id) WHERE reporting_year = {YEAR} AND eui IS NOT NULL GROUP BY ALL)
      SELECT b.board_number, b.slug, coalesce(schools, 0) AS schools, coalesce(benchmarked, 0) AS benchmarked, round(med, 9) AS median_eui, round(sc, 6) AS median_score
      FROM boards b LEFT JOIN c USING (board_number) LEFT JOIN m USING (board_number)""",
)
def _(t):
    p = D.board_profiles(V.schools(t), V.boards(t), _metrics(t), YEAR)
    return p.select("board_number", "slug", "schools", "benchmarked", r("median_eui", 9).alias("median_eui"), r("median_score").alias("median_score"))


@query(
    "rp8_board_yearly",
    VW + """ SELECT board_number, reporting_year AS year, count(*) AS facilities, round(sum(total_site_energy_gj) FILTER (NOT list_contains(flags, 'implausible_intensity')), 4) AS energy,
      round(sum(ghg_kg_co2e) FILTER (NOT list_contains(flags, 'implausible_intensity')), 2) AS ghg, count(*) FILTER (list_contains(flags, 'implausible_intensity')) AS excluded
      FROM energy JOIN facilities USING (facility_id) GROUP BY ALL""",
)
def _(t):
    y = D.board_yearly(V.energy_records(t), V.facilities(t))
    return y.select("board_number", "year", "facilities", r("total_energy_gj", 4).alias("energy"), r("total_ghg_kg", 2).alias("ghg"), F.col("excluded_implausible").alias("excluded"))


@query(
    "rp9_coverage",
    VW + """ SELECT 'year' AS section, CAST(reporting_year AS VARCHAR) AS label, count(*) AS n FROM energy GROUP BY ALL
      UNION ALL SELECT 'status', match_status, count(*) FROM facilities GROUP BY ALL
      UNION ALL SELECT 'records', 'flagged', count(*) FROM energy WHERE len(flags) > 0
      UNION ALL SELECT 'records', 'implausible', count(*) FROM energy WHERE list_contains(flags, 'implausible_intensity')""",
)
def _(t):
    return D.coverage(V.energy_records(t), V.facilities(t))


@query("rp10_available_years", "SELECT DISTINCT year(o_orderdate) AS reporting_year FROM orders")
def _(t):
    return D.available_years(t.orders.select(F.year("o_orderdate").alias("reporting_year")))


@query("rp10_list_boards", VW + " SELECT slug, name FROM boards")
def _(t):
    return D.distinct_options(V.boards(t), "name", "slug").select("slug", "name")


@query(
    "rp11_statistics_export",
    VW + """ SELECT 'coverage' AS section, count(*) AS parts FROM (SELECT reporting_year FROM energy GROUP BY ALL UNION ALL SELECT 1 FROM (SELECT match_status FROM facilities GROUP BY ALL) UNION ALL SELECT unnest([1, 2]))
      UNION ALL SELECT 'home', 1 UNION ALL SELECT 'year', count(DISTINCT reporting_year) FROM energy
      UNION ALL SELECT 'level', count(*) FROM (SELECT school_level FROM entity_years WHERE school_id IS NOT NULL AND category = 'school' AND eui IS NOT NULL AND reporting_year = 2001 GROUP BY ALL)""",
)
def _(t):
    m, e = _metrics(t), V.energy_records(t)
    parts = D.statistics_export(
        D.home_stats(V.schools(t), e, m), D.overview_by_year(e, m), D.overview_by(m, YEAR, ["school_level"]), D.coverage(e, V.facilities(t))
    )
    return parts.groupBy("section").agg(F.count("json").alias("parts"))


@query(
    "rp12_distribution_quantiles",
    VW + f""" SELECT reporting_year, count(*) AS n, round(quantile_cont(eui, 0.25), 9) AS q25, round(quantile_cont(eui, 0.5), 9) AS q50, round(quantile_cont(eui, 0.75), 9) AS q75, round(quantile_cont(eui, 0.95), 9) AS q95
      FROM entity_years WHERE school_id IS NOT NULL AND category = 'school' AND eui IS NOT NULL AND reporting_year = {YEAR} GROUP BY ALL""",
)
def _(t):
    q = D.distribution_quantiles(_stored_entities(t), YEAR)
    return q.select("reporting_year", "n", *[r(c, 9).alias(c) for c in ("q25", "q50", "q75", "q95")])


# ---- checks -------------------------------------------------------------------------------------


def _broken(t):
    """The views with violations put in on purpose."""
    key = F.col("facility_id")
    facilities = V.facilities(t).withColumn("school_id", F.when(key % 50 != 1, F.col("school_id")))
    schools = V.schools(t).withColumn("board_number", F.when(F.col("school_id") % 90 == 0, "none").otherwise(F.col("board_number")))
    energy = V.energy_records(t)
    metrics = E.combine_entity_years(V.facility_years(t)).filter("reporting_year <> 1996").select(
        "school_id", "facility_id", "reporting_year",
        F.when(F.col("eui").isNotNull(), (F.floor("eui").cast("long") * 40) % 160).alias("opportunity_score"),
        (F.col("reporting_year") % 20).alias("peer_count"),
    )
    return V.boards(t), schools, facilities, energy.unionByName(energy.filter("facility_id % 70 = 3")), metrics


@query(
    "ck1_ck9_check_report",
    VW + """, f AS (SELECT * REPLACE (CASE WHEN facility_id % 50 <> 1 THEN school_id END AS school_id) FROM facilities),
      s AS (SELECT * REPLACE (CASE WHEN school_id % 90 = 0 THEN 'none' ELSE board_number END AS board_number) FROM schools),
      en AS (SELECT * FROM energy UNION ALL SELECT * FROM energy WHERE facility_id % 70 = 3),
      m AS (SELECT school_id, facility_id, reporting_year, CASE WHEN eui IS NOT NULL THEN (CAST(floor(eui) AS BIGINT) * 40) % 160 END AS sc, reporting_year % 20 AS pc FROM entity_years WHERE reporting_year <> 1996),
      c AS (SELECT 'Matched facilities without a school' AS name, count(*) AS count, true AS expect_zero FROM f WHERE match_status = 'matched' AND school_id IS NULL
        UNION ALL SELECT 'School set without a match', count(*), true FROM f WHERE match_status <> 'matched' AND school_id IS NOT NULL
        UNION ALL SELECT 'Schools pointing at a missing board', count(*), true FROM s LEFT JOIN boards b USING (board_number) WHERE b.name IS NULL
        UNION ALL SELECT 'Duplicate facility-years', count(*), true FROM (SELECT facility_id, reporting_year FROM en GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'Scores outside 0–100', count(*), true FROM m WHERE sc NOT BETWEEN 0 AND 100
        UNION ALL SELECT 'Scores shown with fewer than 10 peers', count(*), true FROM m WHERE sc IS NOT NULL AND pc < 10
        UNION ALL SELECT 'Metrics without exactly one of school and facility', count(*), true FROM m WHERE (school_id IS NULL) = (facility_id IS NULL)
        UNION ALL SELECT 'Matched facility-years missing from peer metrics', count(*), true FROM (SELECT DISTINCT f.school_id, reporting_year FROM en JOIN f USING (facility_id) WHERE f.school_id IS NOT NULL) x
          ANTI JOIN (SELECT * FROM m WHERE school_id IS NOT NULL) y USING (school_id, reporting_year)
        UNION ALL SELECT 'Coordinates out of range', count(*), true FROM s WHERE NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
        UNION ALL SELECT 'Match confidence outside 0..1', count(*), true FROM f WHERE match_confidence NOT BETWEEN 0 AND 1
        UNION ALL SELECT 'Reporting years outside 2000..2100', count(*), true FROM en WHERE reporting_year NOT BETWEEN 2000 AND 2100
        UNION ALL SELECT 'Duplicate school numbers', count(*), true FROM (SELECT school_number FROM s GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'Energy records', count(*), false FROM en UNION ALL SELECT 'Schools with coordinates', count(*), false FROM s WHERE latitude IS NOT NULL)
      SELECT name, count, expect_zero, (count = 0) = expect_zero AS ok, false AS all_ok FROM c""",
)
def _(t):
    return K.standard_checks(*_broken(t))


@query("ck2_orphans", VW + " SELECT school_id FROM schools WHERE school_id % 90 = 0")
def _(t):
    boards, schools, _, _, _ = _broken(t)
    return K.orphans(schools, boards, ["board_number"]).select("school_id")


@query("ck3_duplicates", VW + " SELECT facility_id, reporting_year, CAST(2 AS BIGINT) AS copies FROM energy WHERE facility_id % 70 = 3")
def _(t):
    return K.duplicates(_broken(t)[3], ["facility_id", "reporting_year"])

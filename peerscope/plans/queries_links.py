"""Joins, record linkage, fuzzy lookup, set operations, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerscope.functions import text as X
from peerscope.operators import checks as K
from peerscope.operators import entities as E
from peerscope.operators import linkage as L
from peerscope.operators import lookup as S
from peerscope.plans import ingest as I
from peerscope.plans import reads as D
from peerscope.plans import views as V
from peerscope.plans.queries_text import ORGANIZATION_SQL, organizations, sql_board_key, sql_fold, sql_query_key, sql_school, sql_expand, sql_words
from peerscope.plans.registry import joined, query, r
from peerscope.session import materialize, scratch_folder
from peerscope.sources import files as FI
from peerscope.sources import grids as G
from peerscope.sources import sinks as W

VW = V.VIEWS_SQL
YEAR = 2001


# ---- joins --------------------------------------------------------------------------------------


@query("jn1_facility_years", VW + " SELECT facility_id, reporting_year, school_id, school_level, match_confidence, round(total_site_energy_gj, 4) AS energy FROM records")
def _(t):
    return V.facility_years(t).select("facility_id", "reporting_year", "school_id", "school_level", "match_confidence", r("total_site_energy_gj", 4).alias("energy"))


@query(
    "jn2_schools_with_year",
    VW + f""" SELECT s.slug, b.slug AS board_slug, e.reporting_year, round(e.eui, 9) AS eui FROM schools s JOIN boards b USING (board_number)
      LEFT JOIN (SELECT * FROM entity_years WHERE reporting_year = {YEAR} AND school_id IS NOT NULL) e USING (school_id)""",
)
def _(t):
    wanted = E.combine_entity_years(V.facility_years(t).filter(F.col("reporting_year") == YEAR)).filter("school_id is not null")
    named = V.boards(t).select("board_number", F.col("slug").alias("board_slug"))
    rows = V.schools(t).join(named, "board_number").join(wanted.select("school_id", "reporting_year", "eui"), "school_id", "left")
    return rows.select("slug", "board_slug", "reporting_year", r("eui", 9).alias("eui"))


@query("jn3_board_energy", VW + " SELECT facility_id, reporting_year, round(total_site_energy_gj, 4) AS energy FROM energy JOIN facilities USING (facility_id) WHERE board_number = '3'")
def _(t):
    board = V.facilities(t).filter("board_number = '3'").select("facility_id")
    return V.energy_records(t).join(board, "facility_id").select("facility_id", "reporting_year", r("total_site_energy_gj", 4).alias("energy"))


@query(
    "jn4_map_join",
    VW + f""" SELECT s.slug, b.name AS board_name, round(e.eui, 9) AS eui FROM schools s JOIN boards b USING (board_number) JOIN entity_years e USING (school_id)
      WHERE e.reporting_year = {YEAR} AND e.eui IS NOT NULL AND latitude IS NOT NULL""",
)
def _(t):
    e = E.combine_entity_years(V.facility_years(t).filter(F.col("reporting_year") == YEAR))
    metrics = e.select("school_id", "reporting_year", "eui", F.lit(None).cast("double").alias("eui_percentile"), F.lit(None).cast("int").alias("opportunity_score"), "ghg_intensity")
    return D.map_points(V.schools(t), V.boards(t), metrics, YEAR).select("slug", "board_name", r("eui", 9).alias("eui"))


@query("jn5_board_grouping", VW + " SELECT b.region, e.reporting_year, count(*) AS entities FROM entity_years e JOIN schools s USING (school_id) JOIN boards b USING (board_number) GROUP BY ALL")
def _(t):
    e = E.combine_entity_years(V.facility_years(t)).select("school_id", "reporting_year")
    rows = e.join(V.schools(t).select("school_id", "board_number"), "school_id").join(V.boards(t).select("board_number", "region"), "board_number")
    return rows.groupBy("region", "reporting_year").agg(F.count("*").alias("entities"))


def _board_directory(t):
    return t.nation.select(
        F.col("n_nationkey").cast("string").alias("board_number"),
        F.when(F.col("n_nationkey") % 9 == 8, F.lit("Shared DSB")).otherwise(F.concat("n_name", F.lit(" District School Board"))).alias("name"),
    )


def _aliases(t):
    other = ((F.col("n_nationkey") + 1) % 25).cast("string")
    rows = t.nation.filter("n_nationkey % 2 = 0")
    former = rows.select(F.concat(F.lit("Former Authority — "), "n_name").alias("organization_name"), other.alias("board_number"), F.col("n_nationkey").alias("line"))
    taken = rows.filter("n_nationkey % 10 = 4").select(F.concat("n_name", F.lit(" DSB")).alias("organization_name"), other.alias("board_number"), F.col("n_nationkey").alias("line"))
    return former.unionByName(taken)


@query(
    "jn6_board_resolution",
    f"""WITH b AS (SELECT CAST(n_nationkey AS VARCHAR) AS board_number, CASE WHEN n_nationkey % 9 = 8 THEN 'Shared DSB' ELSE n_name || ' District School Board' END AS name FROM nation),
      look AS (SELECT {sql_board_key('name')} AS key, min(board_number) AS board_number FROM b GROUP BY ALL HAVING count(DISTINCT board_number) = 1),
      al AS (SELECT 'Former Authority — ' || n_name AS o, CAST((n_nationkey + 1) % 25 AS VARCHAR) AS board_number FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT n_name || ' DSB', CAST((n_nationkey + 1) % 25 AS VARCHAR) FROM nation WHERE n_nationkey % 10 = 4),
      alk AS (SELECT {sql_board_key('o')} AS key, min(board_number) AS board_number FROM al GROUP BY ALL),
      org AS (SELECT DISTINCT {ORGANIZATION_SQL} AS organization_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT organization_name, coalesce(a.board_number, l.board_number) AS board_number FROM (SELECT *, {sql_board_key('organization_name')} AS key FROM org) o
        LEFT JOIN look l USING (key) LEFT JOIN alk a USING (key)""",
)
def _(t):
    return L.resolve_boards(organizations(t), _board_directory(t), _aliases(t))


def _facilities(t):
    return V.facilities(t).select(F.col("facility_id").cast("string").alias("facility_key"), "facility_name", "street", "city", "board_number")


_KEYED = f"""f AS (SELECT CAST(facility_id AS VARCHAR) AS facility_key, board_number, {sql_school('facility_name')} AS n, {sql_expand(sql_words(sql_fold('street')), X.STREET_WORDS)} AS a, {sql_fold('city')} AS c FROM facilities),
  s AS (SELECT school_number, board_number, {sql_school('name')} AS n, {sql_expand(sql_words(sql_fold('street')), X.STREET_WORDS)} AS a, {sql_fold('city')} AS c FROM schools)"""


@query("jn7_exact_name_tier", VW + ", " + _KEYED + " SELECT facility_key, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(school_number) END AS school_number FROM f JOIN s USING (board_number, n) GROUP BY ALL")
def _(t):
    keyed, directory = L.linkage_keys(_facilities(t), "facility_name"), L.linkage_keys(V.schools(t), "name")
    profiles = keyed.select("board_number", "_name").distinct()
    tier = L._exact(profiles, directory, ["board_number", "_name"], "exact_name_board")
    return keyed.join(tier, ["board_number", "_name"]).select("facility_key", F.col("candidate_count").alias("candidates"), "school_number")


@query(
    "jn8_address_tier",
    VW + ", " + _KEYED + " SELECT facility_key, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(school_number) END AS school_number FROM f JOIN s USING (board_number, a, c) WHERE a <> '' GROUP BY ALL",
)
def _(t):
    keys = ["board_number", "_address", "_city"]
    keyed, directory = L.linkage_keys(_facilities(t), "facility_name"), L.linkage_keys(V.schools(t), "name")
    profiles = keyed.filter("_address <> ''").select(*keys).distinct()
    tier = L._exact(profiles, directory.filter("_address <> ''"), keys, "address_board")
    return keyed.join(tier, keys).select("facility_key", F.col("candidate_count").alias("candidates"), "school_number")


#: Common blocks of couples (a, b) of texts: the longest one, the first in a and then in b, and the same to its left and right.
_BLOCKS = """blocks AS (
    SELECT a AS one, b AS two, a, b, 0::BIGINT AS size FROM (SELECT DISTINCT a, b FROM couples)
    UNION ALL
    SELECT one, two, unnest([a[1:block.i - 1], a[block.i + block.n:]]), unnest([b[1:strpos(b, a[block.i:block.i + block.n - 1]) - 1], b[strpos(b, a[block.i:block.i + block.n - 1]) + block.n:]]), unnest([block.n, 0])
    FROM (SELECT one, two, a, b, list_filter(flatten(list_transform(range(least(length(a), length(b)), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: {'n': n, 'i': i}))),
        lambda x: contains(b, a[x.i:x.i + x.n - 1]))[1] AS block FROM blocks WHERE a <> '' AND b <> '') WHERE block IS NOT NULL),
  ratio AS (SELECT one AS a, two AS b, 2.0::DOUBLE * sum(size) / (length(one) + length(two)) AS score FROM blocks GROUP BY one, two)"""
_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"


#: Names of facilities and schools that share a board; shorter ones that cannot reach the lower threshold are left out.
_NAMES = f"""p AS (SELECT DISTINCT board_number, n, a, c, concat_ws('|', board_number, c) AS city FROM f),
  texts AS (SELECT *, {_SORTED.format('n')} AS t, concat_ws('|', board_number, c) AS city FROM s),
  named AS (SELECT DISTINCT concat_ws('|', board_number) AS board_number, city, n, {_SORTED.format('n')} AS t FROM p),
  couples AS (SELECT DISTINCT l.t AS a, r.t AS b FROM named l JOIN (SELECT DISTINCT concat_ws('|', board_number) AS board_number, t FROM texts) r USING (board_number)
    WHERE l.t <> '' AND r.t <> '' AND 2 * least(length(l.t), length(r.t)) >= 0.75 * (length(l.t) + length(r.t)))"""


def _best(name: str, block: str, threshold: float, keep: int, profiles: str = "named") -> str:
    """SQL: the best schools of each block and name, at most ``keep``, with their position."""
    return f"""{name} AS (SELECT block, left_name, school_number, score, position FROM (
      SELECT l.{block} AS block, l.n AS left_name, r.school_number, score, row_number() OVER (PARTITION BY l.{block}, l.n ORDER BY score DESC, r.school_number) AS position
      FROM (SELECT DISTINCT {block}, n, t FROM {profiles}) l JOIN (SELECT *, row_number() OVER (PARTITION BY {block}, n ORDER BY school_number) AS nth FROM (SELECT * REPLACE (concat_ws('|', board_number) AS board_number) FROM texts)) r
        ON l.{block} = r.{block} AND r.nth <= {keep} JOIN ratio ON ratio.a = l.t AND ratio.b = r.t WHERE score >= {threshold}) WHERE position <= {keep})"""


def _near(name: str, source: str) -> str:
    """SQL: what the tier of similar names accepts of its best two schools."""
    return f"""{name} AS (SELECT block, left_name, school_number, score FROM (SELECT *, max(score) OVER w AS best, min(score) OVER w AS second, count(*) OVER w AS k FROM {source} WINDOW w AS (PARTITION BY block, left_name))
      WHERE best >= 0.9 AND (position = 1 OR (k > 1 AND best - second < 0.05)))"""


_LINKED = VW.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _KEYED + ", " + _NAMES + ", " + _BLOCKS


def _profiles(t):
    return L.linkage_keys(_facilities(t), "facility_name").select("board_number", "_name", "_address", "_city").distinct()


@query("jn9_similar_name_tier", _LINKED + ", " + _best("top", "city", 0.85, 2) + ", " + _near("near", "top") + " SELECT block, left_name, school_number, round(score, 6) AS score FROM near")
def _(t):
    return L.similar_in_city(_profiles(t), L.linkage_keys(V.schools(t), "name")).select("block", "left_name", "school_number", r("score").alias("score"))


@query("jn10_fuzzy_tier", _LINKED + ", " + _best("loose", "board_number", 0.75, 3) + " SELECT block, left_name, position, school_number, round(score, 6) AS score FROM loose")
def _(t):
    return L.fuzzy_in_board(_profiles(t), L.linkage_keys(V.schools(t), "name")).select("block", "left_name", "position", "school_number", r("score").alias("score"))


_WORD = "translate(md5(CAST({0} AS VARCHAR)), '0123456789abcdef', 'abcdefghijklmnop')"
_MADE_UP = sql_school(f"substr({_WORD.format('k')}, 1, 6) || ' ' || substr(substr({_WORD.format('k % 500')}, 9, 9), 1, 4 + k % 5)")


@query(
    "ud1_similar_name_pairs",
    f"""WITH RECURSIVE l AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS block, {_MADE_UP} AS n FROM (SELECT c_custkey AS k, * FROM customer)),
      r AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS block, {_MADE_UP} AS n FROM (SELECT s_suppkey AS k, * FROM supplier)),
      met AS (SELECT block, l.n AS left_name, r.n AS right_name, {_SORTED.format('l.n')} AS a, {_SORTED.format('r.n')} AS b FROM l JOIN r USING (block)),
      couples AS (SELECT a, b FROM met), """ + _BLOCKS + " SELECT block, left_name, right_name, round(score, 6) AS score FROM met JOIN ratio USING (a, b) WHERE score >= 0.75",
)
def _(t):
    def names(key, nation):
        # two made-up words of varying length; no word that all names share
        words = F.concat(V.pseudo_word(key, 1, 6), F.lit(" "), F.substr(V.pseudo_word(key % 500, 9, 9), F.lit(1), (4 + key % 5).cast("int")))
        return F.col(nation).cast("string").alias("block"), X.normalize_school_name(words).alias("name")

    left = t.customer.select(*names(F.col("c_custkey"), "c_nationkey"))
    right = t.supplier.select(*names(F.col("s_suppkey"), "s_nationkey"))
    return L.similar_name_pairs(left, right, 0.75).withColumn("score", r("score"))


@query(
    "jn11_attach_coordinates",
    """WITH p AS (SELECT CAST(o_custkey % 2000 AS VARCHAR) AS k, o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE 42 + o_orderkey % 10 END AS lat FROM orders),
      off AS (SELECT k, arg_max(lat, line) AS lat FROM p WHERE lat >= 41.5 GROUP BY ALL), man AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, 45.5 AS lat FROM supplier)
      SELECT CAST(p_partkey AS VARCHAR) AS school_number, CAST(coalesce(man.lat, off.lat) AS DOUBLE) AS latitude, CASE WHEN coalesce(man.lat, off.lat) IS NOT NULL THEN -80::DOUBLE END AS longitude,
        CASE WHEN man.lat IS NOT NULL THEN 'manual-override' WHEN off.lat IS NOT NULL THEN 'official' END AS coordinates_source
      FROM part LEFT JOIN off ON off.k = CAST(p_partkey AS VARCHAR) LEFT JOIN man ON man.k = CAST(p_partkey AS VARCHAR)""",
)
def _(t):
    key = F.col("o_orderkey")
    latitude = F.when(key % 3 == 0, "30").otherwise((42 + key % 10).cast("string"))
    points = t.orders.select((F.col("o_custkey") % 2000).cast("string").alias("school_number"), latitude.alias("latitude"), F.lit("-80").alias("longitude"), key.alias("line"))
    manual = t.supplier.select(F.col("s_suppkey").cast("string").alias("school_number"), F.lit("45.5").alias("latitude"), F.lit("-80.0").alias("longitude"), F.col("s_suppkey").alias("line"))
    schools = t.part.select(F.col("p_partkey").cast("string").alias("school_number"))
    return I.attach_coordinates(schools, points, manual, "official")


@query("jn13_orphans", "SELECT DISTINCT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def _(t):
    finished = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return K.orphans(t.customer.select("c_custkey"), finished, ["c_custkey"]).distinct()


def _overrides(t):
    key = F.col("facility_id")
    return V.facilities(t).filter("facility_id % 25 = 9").select(
        key.cast("string").alias("facility_key"),
        F.when(key % 2 == 0, "no_match").otherwise("match").alias("decision"),
        F.when(key % 2 == 1, F.lit("1")).alias("school_number"),
    )


@query(
    "jn14_overrides",
    VW + """ SELECT CAST(facility_id AS VARCHAR) AS facility_key, CASE WHEN facility_id % 2 = 0 THEN 'rejected' ELSE 'matched' END AS match_status, 'override' AS match_method,
      CASE WHEN facility_id % 2 = 1 THEN 1.0::DOUBLE END AS match_confidence, CASE WHEN facility_id % 2 = 1 THEN '1' END AS school_number FROM facilities WHERE facility_id % 25 = 9""",
)
def _(t):
    overrides = _overrides(t)
    L.check_overrides(overrides, V.schools(t))
    matches, _ = L.match_facilities(_facilities(t), V.schools(t), overrides)
    return matches.filter("match_method = 'override'").select("facility_key", "match_status", "match_method", "match_confidence", "school_number")


_CASCADE = (
    _LINKED + """, known AS (SELECT * FROM p WHERE board_number IS NOT NULL),
      t1 AS (SELECT k.*, x.school, x.k AS k FROM known k JOIN (SELECT board_number, n, min(school_number) AS school, count(*) AS k FROM s GROUP BY ALL) x USING (board_number, n)),
      left1 AS (SELECT * FROM known ANTI JOIN t1 USING (board_number, n)),
      t2 AS (SELECT l.*, x.school, x.k AS k FROM left1 l JOIN (SELECT board_number, a, c, min(school_number) AS school, count(*) AS k FROM s WHERE a <> '' GROUP BY ALL) x USING (board_number, a, c) WHERE a <> ''),
      left2 AS (SELECT *, """ + _SORTED.format("n") + """ AS t FROM left1 ANTI JOIN t2 USING (board_number, n, a, c)), """
    + _best("top", "city", 0.85, 2, "left2") + ", " + _near("near", "top") + """,
      t3 AS (SELECT l.*, x.school, x.k AS k FROM left2 l JOIN (SELECT block, left_name, min(school_number) AS school, count(*) AS k FROM near GROUP BY ALL) x ON x.block = l.city AND x.left_name = l.n),
      left3 AS (SELECT * FROM left2 ANTI JOIN t3 USING (board_number, n, a, c)), """
    + _best("loose", "board_number", 0.75, 3, "left3") + """,
      t4 AS (SELECT l.*, CAST(NULL AS VARCHAR) AS school, x.k AS k FROM left3 l JOIN (SELECT block, left_name, count(*) AS k FROM loose GROUP BY ALL) x ON x.block = l.board_number AND x.left_name = l.n),
      found AS (SELECT board_number, n, a, c, 'exact_name_board' AS method, 1.0::DOUBLE AS sure, school, k, concat_ws('|', 'exact_name_board', board_number, n) AS g FROM t1
        UNION ALL SELECT board_number, n, a, c, 'address_board', 0.95, school, k, concat_ws('|', 'address_board', board_number, a, c) FROM t2
        UNION ALL SELECT board_number, n, a, c, 'name_city_board', 0.85, school, k, concat_ws('|', 'name_city_board', city, n) FROM t3
        UNION ALL SELECT board_number, n, a, c, 'fuzzy', 0.5, school, k, concat_ws('|', 'fuzzy', board_number, n) FROM t4),
      held AS (SELECT facility_key, CAST(facility_key AS BIGINT) AS id, method, sure, CASE WHEN k = 1 AND method <> 'fuzzy' THEN school END AS school, k, g FROM f LEFT JOIN found USING (board_number, n, a, c)),
      matches AS (SELECT facility_key, CASE WHEN id % 25 = 9 THEN CASE WHEN id % 2 = 1 THEN 'matched' ELSE 'rejected' END WHEN method IS NULL THEN 'unmatched' WHEN school IS NOT NULL THEN 'matched' ELSE 'ambiguous' END AS match_status,
        CASE WHEN id % 25 = 9 THEN 'override' ELSE method END AS match_method, CASE WHEN id % 25 = 9 THEN CASE WHEN id % 2 = 1 THEN 1.0::DOUBLE END ELSE sure END AS match_confidence,
        CASE WHEN id % 25 = 9 THEN CASE WHEN id % 2 = 1 THEN '1' END ELSE school END AS school_number,
        CASE WHEN id % 25 <> 9 AND method IS NOT NULL AND school IS NULL THEN g END AS candidate_group, CASE WHEN id % 25 <> 9 AND method IS NOT NULL AND school IS NULL THEN k ELSE 0 END AS candidate_count FROM held)"""
)


@query("sc7_match_facilities", _CASCADE + " SELECT * FROM matches")
def _(t):
    matches, _ = L.match_facilities(_facilities(t), V.schools(t), _overrides(t))
    return matches


@query(
    "sc7_match_candidates",
    _CASCADE + """ SELECT candidate_group, school_number, school_name, method, score FROM (
        SELECT concat_ws('|', 'exact_name_board', s.board_number, n) AS candidate_group, s.school_number, z.name AS school_name, 'exact_name_board' AS method, 1.0::DOUBLE AS score FROM s JOIN schools z USING (school_number)
        UNION ALL SELECT concat_ws('|', 'address_board', s.board_number, a, c), s.school_number, z.name, 'address_board', 0.95 FROM s JOIN schools z USING (school_number)
        UNION ALL SELECT concat_ws('|', 'name_city_board', block, left_name), school_number, z.name, 'name_city_board', 0.85 FROM near JOIN schools z USING (school_number)
        UNION ALL SELECT concat_ws('|', 'fuzzy', block, left_name), school_number, z.name, 'fuzzy', 0.5 FROM loose JOIN schools z USING (school_number))
      WHERE candidate_group IN (SELECT candidate_group FROM matches WHERE match_status = 'ambiguous')""",
)
def _(t):
    _, candidates = L.match_facilities(_facilities(t), V.schools(t), _overrides(t))
    return candidates


@query("jn15_slug_fetch", VW + " SELECT slug, name FROM schools WHERE slug IN (SELECT max(slug) FROM schools)")
def _(t):
    from peerscope.plans.profile import parse_slugs

    schools = V.schools(t)
    wanted = parse_slugs(schools.agg(F.max("slug")).first()[0] + ", unknown-school, Not A Slug")
    return schools.filter(F.col("slug").isin(*wanted)).select("slug", "name")


@query(
    "jn16_slot_merge",
    VW + """ SELECT s.year, t.energy, m.median_eui FROM (SELECT DISTINCT reporting_year AS year FROM energy UNION SELECT 1900) s
      LEFT JOIN (SELECT reporting_year AS year, round(sum(total_site_energy_gj), 4) AS energy FROM energy GROUP BY ALL) t USING (year)
      LEFT JOIN (SELECT reporting_year AS year, round(median(eui), 9) AS median_eui FROM entity_years GROUP BY ALL) m USING (year)""",
)
def _(t):
    from peerscope.operators.ranking import exact_quantiles

    totals = V.energy_records(t).groupBy(F.col("reporting_year").alias("year")).agg(r(F.sum("total_site_energy_gj"), 4).alias("energy"))
    e = E.combine_entity_years(V.facility_years(t)).withColumn("year", F.col("reporting_year"))
    medians = exact_quantiles(e, ["year"], F.col("eui"), {"median_eui": 0.5}).drop("n").withColumn("median_eui", r("median_eui", 9))
    # a slot for a year that nobody reports stays empty
    slots = totals.select("year").union(t.spark.sql("SELECT 1900 AS year")).distinct()
    return slots.join(totals, "year", "left").join(medians, "year", "left")


# ---- review lists, decisions --------------------------------------------------------------------


def _review(t):
    facilities = V.facilities(t).select(
        F.sha2(F.col("facility_id").cast("string"), 256).alias("facility_key"), "match_status", F.col("board_number").alias("organization_name"),
        "facility_name", "operation_type", "street", "city", "board_number", (F.lit(2000) + F.col("facility_id") % 3).alias("latest_year"),
        F.when(F.col("match_status") == "ambiguous", F.col("board_number")).alias("candidate_group"), F.lit(2).alias("candidate_count"),
    )
    return I.review_list(facilities)


@query(
    "lm4_review_list",
    VW + """ SELECT sha256(CAST(facility_id AS VARCHAR)) AS facility_key, match_status AS status, board_number, 2000 + facility_id % 3 AS latest_year,
        CASE WHEN match_status = 'ambiguous' THEN board_number END AS candidate_group
      FROM facilities WHERE match_status IN ('ambiguous', 'unmatched') AND facility_id % 3 = 2 ORDER BY facility_key LIMIT 50""",
)
def _(t):
    return I.list_unresolved(_review(t)).select("facility_key", "status", "board_number", "latest_year", "candidate_group")


@query(
    "lm4_review_candidates",
    VW + " SELECT DISTINCT board_number AS candidate_group, school_number, name AS school_name FROM schools WHERE board_number IN (SELECT board_number FROM facilities WHERE match_status = 'ambiguous')",
)
def _(t):
    candidates = V.schools(t).select(F.col("board_number").alias("candidate_group"), "school_number", F.col("name").alias("school_name"))
    return I.review_candidates(_review(t), candidates)


@query(
    "rp13_apply_decisions",
    VW + """ SELECT facility_key, decision, school_number, note FROM (
        SELECT sha256(CAST(facility_id AS VARCHAR)) AS facility_key, 'no_match' AS decision, CAST(NULL AS VARCHAR) AS school_number, 'checked' AS note FROM facilities WHERE match_status = 'ambiguous'
        UNION ALL SELECT sha256(CAST(facility_id AS VARCHAR)), 'match', '1', 'kept' FROM facilities WHERE match_status = 'matched')""",
)
def _(t):
    hashed = V.facilities(t).withColumn("facility_key", F.sha2(F.col("facility_id").cast("string"), 256))
    note, none = F.lit("checked"), F.lit(None).cast("string")
    decisions = hashed.filter("match_status = 'ambiguous'").select(
        F.when(F.col("facility_id") % 16 == 0, F.substr("facility_key", F.lit(1), F.lit(20))).otherwise(F.col("facility_key")).alias("prefix"),
        F.lit("no_match").alias("decision"), none.alias("school_number"), note.alias("note"), F.col("facility_id").alias("line"),
    )
    existing = hashed.filter("match_status in ('matched', 'ambiguous')").select("facility_key", F.lit("match").alias("decision"), F.lit("1").alias("school_number"), F.lit("kept").alias("note"))
    return I.apply_decisions(existing, decisions, _review(t), V.schools(t))


# ---- fuzzy lookup -------------------------------------------------------------------------------


def _documents(t):
    schools = t.part.select(
        F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_partkey").cast("string").alias("slug"), F.initcap("p_type").alias("city"), F.col("p_brand").alias("board_name")
    )
    boards = t.nation.select(F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))
    return S.search_documents(schools, boards)


def _queries(t):
    words = t.benchmark.select(F.explode(F.split(X.normalize_query(F.col("text")), " ")).alias("text"))
    wrong = t.part.select(F.concat(F.substr("p_name", F.lit(1), F.lit(1)), F.substr("p_name", F.lit(3))).alias("text"))
    names = t.part.select(F.substr("p_name", F.lit(1), F.lit(8)).alias("text"))
    return words.union(wrong).union(names).union(t.nation.select(F.lower("n_name"))).distinct()


_DOCS = f"""docs AS (
    SELECT 'school' AS kind, p_name || ' ' || p_brand AS label, upper(p_type[1]) || lower(p_type[2:]) || ' · ' || p_brand AS sublabel, '/schools/' || p_partkey AS href FROM part
    UNION ALL SELECT 'city', any_value(upper(p_type[1]) || lower(p_type[2:])), count(*) || CASE WHEN count(*) = 1 THEN ' school' ELSE ' schools' END, '/schools?city=' || any_value(upper(p_type[1]) || lower(p_type[2:])) FROM part GROUP BY lower(p_type)
    UNION ALL SELECT 'board', n_name, NULL, '/boards/' || lower(n_name) FROM nation),
  d AS (SELECT *, {sql_query_key('label')} AS folded FROM docs)"""


@query("fs1_search_documents", f"WITH {_DOCS} SELECT kind, label, sublabel, href, folded FROM d")
def _(t):
    return _documents(t).drop("words")


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr(' ' || {0} || ' ', i, 2)))"
_DICE = f"2.0::DOUBLE * len(list_intersect({_GRAMS.format('a')}, {_GRAMS.format('b')})) / (len({_GRAMS.format('a')}) + len({_GRAMS.format('b')}))"


@query("fs2_dice", f"SELECT p_partkey, round({_DICE}, 9) AS dice FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_brand || p_type) AS b FROM part)")
def _(t):
    a, b = F.lower("p_name"), F.lower(F.concat("p_brand", "p_type"))
    return t.part.select("p_partkey", r(S.dice(S.bigrams(a), S.bigrams(b)), 9).alias("dice"))


_SCORES = f"""WITH {_DOCS},
  asked AS (SELECT DISTINCT query FROM (SELECT unnest(string_split({sql_query_key('text')}, ' ')) AS query FROM benchmark
     UNION ALL SELECT {sql_query_key("p_name[1] || p_name[3:]")} FROM part UNION ALL SELECT {sql_query_key("p_name[1:8]")} FROM part UNION ALL SELECT {sql_query_key('n_name')} FROM nation) WHERE length(query) >= 2),
  texts AS (SELECT DISTINCT folded FROM d), tw AS (SELECT DISTINCT folded, unnest(string_split(folded, ' ')) AS b FROM texts),
  qw AS (SELECT query, unnest(string_split(query, ' ')) AS a, unnest(range(len(string_split(query, ' ')))) AS i FROM asked),
  pair AS (SELECT a, b, starts_with(b, a) AS st, CASE WHEN starts_with(b, a) THEN 1.0 ELSE {_DICE} END AS s FROM (SELECT DISTINCT a FROM qw), (SELECT DISTINCT b FROM tw)),
  best AS (SELECT query, i, folded, max(s) AS s, bool_or(st) AS st FROM qw JOIN pair USING (a) JOIN tw USING (b) GROUP BY ALL),
  scored AS (SELECT query, folded, CASE WHEN starts_with(folded, query) THEN 100 WHEN bool_and(st) THEN 80 WHEN contains(folded, query) THEN 60 WHEN avg(s) >= 0.6 THEN 40 * avg(s) ELSE 0 END AS score FROM best GROUP BY query, folded)"""


@query("fs3_scores", _SCORES + " SELECT query, folded, round(score, 6) AS score FROM scored WHERE score > 0")
def _(t):
    return S.lookup_scores(_queries(t), _documents(t)).select("query", "folded", r("score").alias("score")).distinct()


@query(
    "fs4_lookup",
    _SCORES + """, o AS (SELECT query, kind, label, sublabel, href, round(score, 6) AS score, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, folded, label, href) AS position
      FROM scored JOIN d USING (folded) WHERE score > 0) SELECT * FROM o WHERE position <= 6""",
)
def _(t):
    return S.lookup(_queries(t), _documents(t)).withColumn("score", r("score"))


@query("lm2_top_per_kind", "SELECT * FROM (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS position FROM part) WHERE position <= 6")
def _(t):
    from pyspark.sql import Window

    order = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("position", F.row_number().over(order)).filter("position <= 6").select("p_brand", "p_type", "p_partkey", "position")


@query("se2_union_documents", f"WITH {_DOCS} SELECT kind, count(*) AS n FROM d GROUP BY ALL")
def _(t):
    return _documents(t).groupBy("kind").agg(F.count("*").alias("n"))


# ---- sources and sinks: tables go through files and come back -------------------------------------

_ORDER_ALIASES = {
    "order": ["order key", "order no", "id"],
    "customer": ["customer key", "client"],
    "price": ["total price", "price $", "amount"],
    "note": ["status note", "remarks"],
}
_ORDER_FIELDS = list(_ORDER_ALIASES)


def _layouts(t):
    """Orders in three layouts by year, as text columns."""
    note = F.concat(F.lit("Étape "), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit(', "noted"\nsecond line')).otherwise(""))
    rows = t.orders.withColumn("note", note).withColumn("year", F.year("o_orderdate"))
    key, customer, price = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)")
    early = rows.filter("year <= 1996").select(key.alias("Order Key"), customer.alias("Customer KEY"), price.cast("string").alias("Total Price"), F.col("note").alias("Status / Note"))
    middle = rows.filter("year between 1997 and 1999").select(F.col("note").alias("Remarks"), key.alias("Order No."), F.lit("x").alias("Region"), F.concat(F.lit("$"), F.format_number(price, 2)).alias("Price $"), customer.alias("Client"))
    late = rows.filter("year >= 2000").select(key.alias("ID"), customer.alias("client"), price.cast("string").alias("Amount"))
    return [(early, "ISO-8859-1"), (middle, "UTF-8"), (late, "UTF-8")]


def _written(t):
    folder = scratch_folder(t.spark, "layouts")
    for i, (df, encoding) in enumerate(_layouts(t)):
        df.write.csv(f"{folder}/{i}", header=True, escape='"', encoding=encoding)
    return [f"{folder}/{i}/*.csv" for i in range(3)]


_NOTE = "'Étape ' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN ', \"noted\"' || chr(10) || 'second line' ELSE '' END"


@query(
    "src1_read_grids",
    f"""SELECT CASE WHEN y <= 1996 THEN concat_ws('|', o_orderkey, o_custkey, price, {_NOTE}) WHEN y <= 1999 THEN concat_ws('|', {_NOTE}, o_orderkey, 'x', '$' || format('{{:,.2f}}', price), o_custkey)
        ELSE concat_ws('|', o_orderkey, o_custkey, price) END AS cells, count(*) AS n FROM (SELECT *, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders) GROUP BY ALL""",
)
def _(t):
    grids = G.read_grids(t.spark, _written(t))
    return grids.filter("row_no > 0").groupBy(joined("cells").alias("cells")).agg(F.count("*").alias("n"))


@query("src2_best_sheet", f"SELECT 'year=' || year(o_orderdate) AS source, CAST(o_orderkey AS VARCHAR) AS \"order\", CAST(o_custkey AS VARCHAR) AS customer, {_NOTE} AS note FROM orders")
def _(t):
    # a source folder a year with two sheets each: the order sheet names more known fields than the notes
    folder = scratch_folder(t.spark, "sheets") + "/books"
    note = F.concat(F.lit("Étape "), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit(', "noted"\nsecond line')).otherwise(""))
    orders = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("Order Key"), F.col("o_custkey").cast("string").alias("Customer KEY"), note.alias("Remarks"))
    orders.repartition("year").write.partitionBy("year").csv(folder, header=True, escape='"')
    labels = orders.select("year").distinct().join(t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label")))
    labels.repartition("year").write.mode("append").partitionBy("year").csv(folder, header=True)
    rows = G.read_records(t.spark, [f"{folder}/*/*.csv"], _ORDER_ALIASES, ["order", "customer"], sheets_in_folders=True)
    return rows.select("source", "order", "customer", "note")


@query(
    "src3_header_names",
    "SELECT 'ID|client|Amount' AS names, CAST(3 AS BIGINT) AS score UNION ALL SELECT 'Order Key|Customer KEY|Total Price|Status / Note', 4 UNION ALL SELECT 'Remarks|Order No.|Region|Price $|Client', 4",
)
def _(t):
    headers = G.detect_headers(G.read_grids(t.spark, _written(t)), G.alias_table(t.spark, _ORDER_ALIASES))
    return headers.select(joined("names").alias("names"), "score").distinct()


@query(
    "src4_map_columns",
    """SELECT canonical, CAST(position AS BIGINT) AS position, CAST(layouts AS BIGINT) AS layouts FROM (VALUES ('customer', 1, 2), ('customer', 4, 1), ('note', 0, 1),
       ('note', 3, 1), ('order', 0, 2), ('order', 1, 1), ('price', 2, 2), ('price', 3, 1)) v(canonical, position, layouts)""",
)
def _(t):
    table = G.alias_table(t.spark, _ORDER_ALIASES)
    grids = G.read_grids(t.spark, _written(t))
    headers = G.detect_headers(grids, table)
    mapping = G.map_columns(headers, table).join(headers.select("source", "sheet", joined("names").alias("layout")), ["source", "sheet"])
    return mapping.select("canonical", "position", "layout").distinct().groupBy("canonical", "position").agg(F.count("*").alias("layouts"))


@query("src5_missing_columns", "SELECT 'note' AS canonical UNION ALL SELECT 'unheard'")
def _(t):
    table = G.alias_table(t.spark, _ORDER_ALIASES)
    headers = G.detect_headers(G.read_grids(t.spark, _written(t)), table)
    return G.missing_columns(headers, G.map_columns(headers, table), ["order", "note", "unheard"]).select("canonical").distinct()


@query(
    "src6_unified_layouts",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS \"order\", CAST(o_custkey AS VARCHAR) AS customer, o_totalprice AS price, CASE WHEN year(o_orderdate) < 2000 THEN {_NOTE} END AS note FROM orders",
)
def _(t):
    from peerscope.functions.units import to_float

    rows = G.read_records(t.spark, _written(t), _ORDER_ALIASES, ["order", "customer", "price"])
    return G.unify([rows], _ORDER_FIELDS).withColumn("price", to_float(F.col("price")))


@query("se1_union_of_parts", "SELECT CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN year(o_orderdate) >= 2000 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS b FROM orders")
def _(t):
    key, customer, year = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.year("o_orderdate")
    parts = [t.orders.filter(year < 2000).select(key.alias("a"), customer.alias("b")), t.orders.filter(year >= 2000).select(key.alias("a"))]
    return G.unify(parts, ["a", "b"])


@query("se4_missing_names", "SELECT p_name AS name FROM part EXCEPT SELECT p_name FROM part WHERE p_size < 5")
def _(t):
    names = t.part.select(F.col("p_name").alias("name"))
    return names.distinct().join(t.part.filter("p_size < 5").select(F.col("p_name").alias("name")), "name", "left_anti")


@query(
    "src7_dead_letters",
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'missing_organization_or_facility_name' ELSE 'unknown_reporting_year' END AS reason, count(*) AS n,
       count(DISTINCT '{"id":"' || o_orderkey || '","status":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS texts
       FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 GROUP BY ALL""",
)
def _(t):
    key = F.col("o_orderkey")
    reason = I.energy_rejection(F.when(key % 5 != 0, F.lit("a")), F.lit("b"), F.when(key % 7 != 0, 2000))
    raw = F.create_map(F.lit("id"), key.cast("string"), F.lit("status"), F.when(F.col("o_custkey") % 2 != 0, F.col("o_orderstatus")))
    rows = t.orders.select(F.lit("orders").alias("source"), key.alias("data_row"), raw.alias("raw"), reason.alias("reject_reason"))
    letters = W.dead_letters(rows.filter("reject_reason is not null"))
    return letters.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("row_json").alias("texts"))


@query("src8_csv_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || ', \"quoted\"' AS name FROM nation")
def _(t):
    path = scratch_folder(t.spark, "csv") + "/rows"
    W.write_csv(t.nation.select("n_nationkey", F.concat("n_name", F.lit(', "quoted"')).alias("name")), path)
    return t.spark.read.csv(path, header=True, schema="n_nationkey int, name string", escape='"')


@query(
    "src8_report_files",
    VW + """, c AS (SELECT board_number, string_agg(school_number || ' ' || name, '; ' ORDER BY CAST(school_number AS BIGINT)) AS candidates FROM schools GROUP BY ALL)
      SELECT 'review' AS file, sha256(CAST(facility_id AS VARCHAR)) AS key, match_status || '|' || (2000 + facility_id % 3) || '|' || CASE WHEN match_status = 'ambiguous' THEN coalesce(candidates, '') ELSE '' END AS line
        FROM facilities LEFT JOIN c USING (board_number) WHERE match_status IN ('ambiguous', 'unmatched')
      UNION ALL SELECT 'rejected', CAST(o_orderkey AS VARCHAR), 'unknown_reporting_year|{"id":"' || o_orderkey || '"}' FROM orders WHERE o_orderkey % 7 = 0
      UNION ALL SELECT 'summary', 'status ' || match_status, CAST(count(*) AS VARCHAR) FROM facilities GROUP BY match_status""",
)
def _(t):
    candidates = V.schools(t).select(F.col("board_number").alias("candidate_group"), "school_number", F.col("name").alias("school_name"))
    bad = t.orders.filter("o_orderkey % 7 = 0").select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("data_row"), F.lit("unknown_reporting_year").alias("reject_reason"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")).alias("raw")
    )
    counts = V.facilities(t).groupBy(F.col("match_status").alias("label")).agg(F.count("*").alias("n")).select(F.lit("status").alias("section"), "label", "n")
    paths = I.write_reports(scratch_folder(t.spark, "reports"), _review(t), candidates, bad, counts)
    read = lambda name: t.spark.read.csv(paths[name], header=True, escape='"', multiLine=True)
    review = I.with_candidates(read("match-review"), read("match-candidates")).select(F.lit("review").alias("file"), F.col("facility_key").alias("key"), F.concat_ws("|", "status", "latest_year", "candidates").alias("line"))
    rejected = read("rejected-rows").select(F.lit("rejected").alias("file"), F.col("data_row").alias("key"), F.concat_ws("|", "reason", "row_json").alias("line"))
    summary = t.spark.read.schema("section string, label string, n long").json(paths["ingestion-summary"])
    return review.unionByName(rejected).unionByName(summary.select(F.lit("summary").alias("file"), F.concat_ws(" ", "section", "label").alias("key"), F.col("n").cast("string").alias("line")))


@query(
    "src9_json_export",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def _(t):
    path = scratch_folder(t.spark, "json") + "/rows"
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    W.write_json(t.orders.select("o_orderkey", price.alias("price"), F.col("o_orderdate").cast("date").alias("day")), path)
    return t.spark.read.schema("o_orderkey long, price double, day string").json(path)


@query(
    "snk1_upsert",
    """SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN year(o_orderdate) >= 1997 THEN 'new' ELSE 'old' END AS version, o_totalprice, year(o_orderdate) >= 1997 AS rewritten FROM orders""",
)
def _(t):
    path = scratch_folder(t.spark, "upsert") + "/orders"
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    # orders of 1997 and 1998 are stored without a price, those of 1999 under a wrong year; the payload replaces and moves them
    old = rows.filter("year <= 1999").select("o_orderkey", F.lit("old").alias("version"), F.when(F.col("year") < 1997, F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("year") == 1999, 1890).otherwise(F.col("year")).alias("year"))
    old.write.partitionBy("year").parquet(path)
    files = t.spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    before = materialize(files)
    new = rows.filter("year >= 1997").select("o_orderkey", F.lit("new").alias("version"), "o_totalprice", "year")
    merged = W.upsert_partitions(t.spark, path, new, ["o_orderkey"], ["year"])
    kept = merged.select("*", F.col("_metadata.file_path").alias("file")).join(before.withColumn("kept", F.lit(True)), "file", "left")
    return kept.select("o_orderkey", "year", "version", "o_totalprice", F.col("kept").isNull().alias("rewritten"))


@query(
    "snk2_load_links",
    VW + " SELECT f.facility_id, CASE WHEN match_status = 'matched' THEN CAST(s.school_id AS VARCHAR) END AS school_number, b.slug AS board_slug FROM facilities f JOIN boards b USING (board_number) LEFT JOIN schools s USING (school_id)",
)
def _(t):
    numbers = V.schools(t).select("school_id", "school_number")
    named = V.boards(t).select("board_number", F.col("slug").alias("board_slug"))
    rows = V.facilities(t).join(named, "board_number").join(numbers, "school_id", "left")
    return rows.select("facility_id", F.when(F.col("match_status") == "matched", F.col("school_number")).alias("school_number"), "board_slug")


@query("snk3_replace_table", "SELECT o_orderkey, o_custkey, year(o_orderdate) AS reporting_year FROM orders")
def _(t):
    folder = scratch_folder(t.spark, "replace")
    table = "replaced_" + folder.rsplit("-", 1)[-1]
    rows = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("reporting_year"))
    # what a full replace must remove: other years and other keys
    W.replace_table(rows.withColumn("reporting_year", F.col("reporting_year") - F.col("o_orderkey") % 9).withColumn("o_custkey", F.lit(1).cast("long")), table, folder, ["reporting_year"])
    W.replace_table(rows, table, folder, ["reporting_year"])
    return t.spark.table(table)


@query(
    "snk4_json_safe",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def _(t):
    price = F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return W.json_safe(t.orders.select("o_orderkey", price.alias("price"), F.col("o_orderdate").cast("date").alias("day")))


@query(
    "snk5_export_and_rebuild",
    VW + " SELECT reporting_year, count(*) AS entities, count(eui) AS with_eui FROM entity_years GROUP BY ALL",
)
def _(t):
    from peerscope.plans.benchmark import peer_metrics

    path = scratch_folder(t.spark, "export") + "/rows"
    records = V.facility_years(t).drop("reporting_period_end")
    W.write_json(records, path)
    loaded = t.spark.read.schema(records.schema).json(path)
    metrics = peer_metrics(loaded, V.DISRUPTED_YEARS)
    return metrics.groupBy("reporting_year").agg(F.count("*").alias("entities"), F.count("eui").alias("with_eui"))


@query(
    "snk6_file_hashes",
    """WITH h AS (SELECT 'nation=' || c_nationkey AS folder, sha256(string_agg(c_name || '|' || c_custkey, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY c_nationkey)
      SELECT folder, sha256 FROM h UNION ALL SELECT 'all inputs', sha256(string_agg(sha256, '|' ORDER BY folder)) FROM h""",
)
def _(t):
    path = scratch_folder(t.spark, "hashes") + "/customers"
    lines = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat_ws("|", "c_name", "c_custkey").alias("line"))
    lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", "line").write.partitionBy("nation").text(path)
    hashes = FI.hashed(FI.list_files(t.spark, f"{path}/*/*.txt").select("path", F.col("folder").alias("file"))).select("file", "sha256")
    return hashes.unionByName(FI.source_hash(hashes).select(F.lit("all inputs").alias("file"), F.col("source_hash").alias("sha256"))).withColumnRenamed("file", "folder")


@query(
    "snk7_input_selection",
    """SELECT page_id FROM pages WHERE page_id % 5 IN (0, 4)""",
)
def _(t):
    kind = F.col("page_id") % 5
    name = F.concat(
        F.col("page_id").cast("string"),
        F.when(kind == 1, "_data_FR.xlsx").when(kind == 2, "_Non-Reporters.xlsx").when(kind == 3, "_normalized_school_board.xlsx").otherwise("_final_data_set.xlsx"),
    )
    return t.pages.filter(FI.is_energy_input(name)).select("page_id")


@query("snk7_newest_per_folder", "SELECT split_part(url, '/', 3) AS folder, max(url) AS name FROM pages GROUP BY ALL")
def _(t):
    return FI.newest_per_folder(t.pages.select(F.get(F.split("url", "/"), 2).alias("folder"), F.col("url").alias("name"), "page_id")).select("folder", "name")

"""Text queries: cleaning, folding, dictionary expansion, keys, slugs, hashes, years, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from peerscope.functions import display as D
from peerscope.functions import text as X
from peerscope.plans import views as V
from peerscope.plans.registry import joined, query


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    cleaned = f"regexp_replace(replace({x}, '&', ' and '), '[''’`.]', '', 'g')"
    return f"list_filter(string_split(regexp_replace({cleaned}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def sql_expand(words: str, table: dict[str, str]) -> str:
    entries = ", ".join(f"'{k}': '{v}'" for k, v in table.items())
    return f"array_to_string(list_transform({words}, lambda w: coalesce(MAP {{{entries}}}[w], w)), ' ')"


def sql_header(x: str) -> str:
    return f"array_to_string({sql_words(sql_fold(x))}, ' ')"


def sql_org(x: str) -> str:
    return sql_expand(sql_words(sql_fold(x)), X.BOARD_WORDS)


def sql_board_key(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in X.BOARD_STOP_WORDS)
    return f"array_to_string(list_sort(list_filter(string_split({sql_org(x)}, ' '), lambda w: w <> '' AND w NOT IN ({stops}))), ' ')"


def sql_school(x: str) -> str:
    text = f"lower(coalesce({x}, ''))"
    for short, full in X.FRENCH_ABBREVIATIONS.items():
        text = f"replace({text}, '{short}', ' {full} ')"
    return sql_expand(sql_words(sql_fold(text)), X.SCHOOL_WORDS)


def sql_query_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_fold(x)}, '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("tx1_clean_text", "SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("tx2_fold", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(
    "tx3_tokens",
    f"SELECT doc_id, len({sql_words(sql_fold('text'))}) AS n_words, array_to_string({sql_words(sql_fold('text'))}, '|') AS words FROM documents",
)
def _(t):
    words = X.tokens(X.fold(F.col("text")))
    return t.documents.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.array_join("w", "|").alias("words"))


@query(
    "tx4_expand_words",
    "SELECT conv_id, turn, " + sql_expand(sql_words(sql_fold("text")), {"la": "the", "le": "the", "and": "plus", "the": "la"}) + " AS expanded FROM conversations",
)
def _(t):
    table = {"la": "the", "le": "the", "and": "plus", "the": "la"}
    return t.conversations.select("conv_id", "turn", X.expand(X.tokens(X.fold(F.col("text"))), table).alias("expanded"))


_HEADER = "p_type || ' (' || p_brand || ') – Énergie m2'"


@query("tx5_normalize_header", f"SELECT p_partkey, {sql_header(_HEADER)} AS header FROM part")
def _(t):
    label = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(") – Énergie m²"))
    return t.part.select("p_partkey", X.normalize_header(label).alias("header"))


_ABBREVIATED = (
    "CASE facility_id % 4 WHEN 0 THEN 'É.S. ' || facility_name WHEN 1 THEN 'St. ' || facility_name || ' C.S.S.' "
    "WHEN 2 THEN 'É.É.C. ' || facility_name ELSE facility_name || ' & Jr P.S.' END"
)


def _abbreviated():
    name, kind = F.col("facility_name"), F.col("facility_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("É.S. "), name))
        .when(kind == 1, F.concat(F.lit("St. "), name, F.lit(" C.S.S.")))
        .when(kind == 2, F.concat(F.lit("É.É.C. "), name))
        .otherwise(F.concat(name, F.lit(" & Jr P.S.")))
    )


@query("tx6_normalize_school_name", V.VIEWS_SQL + f" SELECT facility_id, {sql_school(_ABBREVIATED)} AS normalized FROM facilities")
def _(t):
    return V.facilities(t).select("facility_id", X.normalize_school_name(_abbreviated()).alias("normalized"))


def _organization():
    return (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("District School Board of "), "n_name"))
        .when(F.col("c_custkey") % 3 == 1, F.concat("n_name", F.lit(" DSB")))
        .otherwise(F.concat(F.lit("Former Authority — "), "n_name"))
    )


ORGANIZATION_SQL = (
    "CASE c_custkey % 3 WHEN 0 THEN 'District School Board of ' || n_name WHEN 1 THEN n_name || ' DSB' "
    "ELSE 'Former Authority — ' || n_name END"
)


def organizations(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_nationkey", "n_name", _organization().alias("organization_name")
    )


_ORGS = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("tx7_normalize_org_name", f"SELECT c_custkey, {sql_org(ORGANIZATION_SQL)} AS normalized {_ORGS}")
def _(t):
    return organizations(t).select("c_custkey", X.normalize_org_name(F.col("organization_name")).alias("normalized"))


@query("tx8_board_key", f"SELECT c_custkey, {sql_board_key(ORGANIZATION_SQL)} AS board_key {_ORGS}")
def _(t):
    return organizations(t).select("c_custkey", X.board_key(F.col("organization_name")).alias("board_key"))


_STREET = "CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 4 WHEN 0 THEN ' King Street West' WHEN 1 THEN ' Oak Avenue' WHEN 2 THEN ', Chemin du Nord Boulevard' ELSE ' St. Mary''s Rd. East' END"


@query("tx9_normalize_address", f"SELECT s_suppkey, {sql_expand(sql_words(sql_fold(_STREET)), X.STREET_WORDS)} AS address FROM supplier")
def _(t):
    key = F.col("s_suppkey")
    tail = (
        F.when(key % 4 == 0, " King Street West").when(key % 4 == 1, " Oak Avenue").when(key % 4 == 2, ", Chemin du Nord Boulevard").otherwise(" St. Mary's Rd. East")
    )
    return t.supplier.select("s_suppkey", X.normalize_address(F.concat(key.cast("string"), tail)).alias("address"))


_POSTAL = "CASE s_suppkey % 3 WHEN 0 THEN 'l' || s_suppkey % 10 || 's ' || s_suppkey % 7 || 'a' || s_suppkey % 9 WHEN 1 THEN ' K1A-0B1 ' ELSE '  N/A  ' || s_suppkey END"


@query(
    "tx10_postal_code",
    f"""SELECT s_suppkey, CASE WHEN regexp_matches(c, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$') THEN c END AS postal_code,
        CASE WHEN regexp_matches(c, '^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$') THEN c ELSE trim(regexp_replace(raw, '\\s+', ' ', 'g')) END AS shown
        FROM (SELECT s_suppkey, {_POSTAL} AS raw, upper(regexp_replace({_POSTAL}, '[^A-Za-z0-9]', '', 'g')) AS c FROM supplier)""",
)
def _(t):
    key = F.col("s_suppkey")

    def digit(n):
        return (key % n).cast("string")

    raw = (
        F.when(key % 3 == 0, F.concat(F.lit("l"), digit(10), F.lit("s "), digit(7), F.lit("a"), digit(9)))
        .when(key % 3 == 1, " K1A-0B1 ")
        .otherwise(F.concat(F.lit("  N/A  "), key.cast("string")))
    )
    return t.supplier.select("s_suppkey", X.normalize_postal_code(raw).alias("postal_code"), X.postal_code_or_text(raw).alias("shown"))


@query("tx11_slugify", f"SELECT p_partkey, array_to_string(list_concat({sql_words(sql_fold('p_name'))}, {sql_words(sql_fold('p_brand'))}), '-') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slugify(F.col("p_name"), F.col("p_brand")).alias("slug"))


@query(
    "tx12_unique_slugs",
    f"""WITH s AS (SELECT p_partkey, array_to_string({sql_words(sql_fold("p_name || ' ' || p_brand || ' ' || p_type"))}, '-') AS base FROM part)
        SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '-' || CAST(p_partkey AS VARCHAR) END AS slug FROM s""",
)
def _(t):
    from peerscope.operators.slugs import unique_slugs

    parts = [F.col("p_name"), F.col("p_brand"), F.col("p_type")]
    return unique_slugs(t.part, parts, [*parts, F.col("p_partkey").cast("string")]).select("p_partkey", "slug")


@query(
    "tx13_stable_hash",
    "SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority) AS row_hash FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", X.stable_hash(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("row_hash"))


@query(
    "tx14_school_level",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'elementary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'combined' WHEN 3 THEN 'elementary' END AS level
       FROM part""",
)
def _(t):
    label = (
        F.when(F.col("p_size") % 5 == 0, "Elementary").when(F.col("p_size") % 5 == 1, "SECONDAIRE").when(F.col("p_size") % 5 == 2, "Elem/Sec")
        .when(F.col("p_size") % 5 == 3, "École élémentaire").otherwise(F.col("p_type"))
    )
    return t.part.select("p_partkey", X.normalize_school_level(label).alias("level"))


@query("tx15_operation_category", V.VIEWS_SQL + " SELECT facility_id, category FROM facilities")
def _(t):
    return V.facilities(t).select("facility_id", X.operation_category(F.col("operation_type")).alias("category"))


@query(
    "tx16_filter_fold",
    "SELECT doc_id, translate(lower(text), 'àâäáãéèêëíìîïóòôöõúùûüçñ’', 'aaaaaeeeeiiiiooooouuuucn''') AS folded FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.filter_fold(F.col("text")).alias("folded"))


@query("tx17_normalize_query", f"SELECT item_id, {sql_query_key('text')} AS query FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", X.normalize_query(F.col("text")).alias("query"))


@query(
    "tx18_year_in_text",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(2000 + o_custkey % 30 AS BIGINT) WHEN 1 THEN NULL
         WHEN 2 THEN CASE WHEN o_custkey % 30 = 15 THEN 2015 END ELSE NULL END AS year FROM orders""",
)
def _(t):
    year = (2000 + F.col("o_custkey") % 30).cast("string")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("energy_"), year, F.lit("_final ("), year, F.lit(").csv")))
        .when(kind == 1, F.concat(F.lit("no. 1"), year, F.lit("7")))
        .when(kind == 2, F.concat(year, F.lit("-2015 report")))
        .otherwise("undated")
    )
    return t.orders.select("o_orderkey", X.year_in(text).alias("year"))


@query(
    "tx19_parse_year",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 2011 WHEN 2 THEN 2022 ELSE 2010 END AS year
       FROM orders""",
)
def _(t):
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.year("o_orderdate").cast("string")).when(kind == 1, "FY 2011").when(kind == 2, "2022.0").otherwise("0")
    return t.orders.select("o_orderkey", X.parse_year(text, F.lit(2010)).alias("year"))


@query(
    "tx20_reporting_period",
    """SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR + INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS period_start,
              strftime(o_orderdate, '%Y-%m-%d') AS period_end FROM orders""",
)
def _(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("o_orderkey", X.reporting_period(text).alias("p")).select(
        "o_orderkey", F.col("p.start").cast("string").alias("period_start"), F.col("p.end").cast("string").alias("period_end")
    )


@query(
    "tx21_display_formats",
    """WITH x AS (SELECT o_orderkey, o_totalprice AS v, CAST(o_totalprice AS DECIMAL(18,2)) AS d, o_custkey % 131 AS p,
                  CAST(o_custkey % 41 - 20 AS BIGINT) AS s FROM orders),
       y AS (SELECT *, CAST(CASE WHEN d < 100 THEN NULL ELSE round(d, 0) END AS BIGINT) AS whole, CAST(floor(p + 0.5) AS BIGINT) AS n FROM x)
       SELECT o_orderkey, format('{:,}', whole) || ' GJ' AS gj, format('{:,}', whole) || ' m²' AS area,
              n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END
                || ' percentile' AS percentile,
              CASE WHEN s > 0 THEN '+' WHEN s < 0 THEN '−' ELSE '' END || abs(s) || '.0%' AS change FROM y""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        D.gj(F.col("o_totalprice")).alias("gj"),
        D.area(F.col("o_totalprice")).alias("area"),
        D.percentile((F.col("o_custkey") % 131).cast("double")).alias("percentile"),
        D.signed_percent((F.col("o_custkey") % 41 - 20).cast("double")).alias("change"),
    )


@query(
    "js1_json_round_trip",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query(
    "se3_set_union",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({sql_words(sql_fold('text'))}, [lang, source]))), '|') AS words FROM documents""",
)
def _(t):
    words = F.array_union(X.tokens(X.fold(F.col("text"))), F.array("lang", "source"))
    return t.documents.select("doc_id", joined(F.array_sort(words)).alias("words"))

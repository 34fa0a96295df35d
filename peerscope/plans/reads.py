"""Read models over the result tables: lists, overview, boards, map, coverage, options."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.text import filter_fold, fold
from peerscope.functions.units import plausible
from peerscope.operators.ranking import exact_quantiles
from peerscope.session import scratch_folder

SORTS = {"name": "name", "eui": "eui", "score": "opportunity_score", "percentile": "eui_percentile", "year": "latest_year"}
METRICS = ("eui", "percentile", "score", "ghg_intensity")


def school_filters(
    q: str | None = None,
    board: str | None = None,
    city: str | None = None,
    region: str | None = None,
    level: str | None = None,
    city_contains: str | None = None,
    score: tuple[float | None, float | None] = (None, None),
    percentile: tuple[float | None, float | None] = (None, None),
    reported_only: bool = False,
    active: bool | None = None,
) -> Column:
    """Conjunction of the given filters. Text is matched literally, without accents and case."""

    def key(text: str) -> Column:
        return F.regexp_replace(fold(F.lit(text)), "[’`]", "'")

    terms = []
    if active is not None:
        terms.append(F.col("active") == active)
    if q:
        terms.append(F.contains(filter_fold(F.col("name")), key(q)))
    if board:
        terms.append(F.col("board_slug") == board)
    if city:
        terms.append(filter_fold(F.col("city")) == fold(F.lit(city)))
    if city_contains:
        terms.append(F.contains(filter_fold(F.coalesce("city", F.lit(""))), key(city_contains)))
    if region:
        terms.append(F.col("region") == region)
    if level:
        terms.append(F.col("school_level") == level)
    for column, (low, high) in (("opportunity_score", score), ("eui_percentile", percentile)):
        if low is not None:
            terms.append(F.col(column) >= low)
        if high is not None:
            terms.append(F.col(column) <= high)
    if reported_only:
        terms.append(F.col("reporting_year").isNotNull())
    condition = F.lit(True)
    for term in terms:
        condition = condition & term
    return condition


def latest_year(metrics: DataFrame) -> int | None:
    return metrics.agg(F.max("reporting_year")).first()[0]


def available_years(metrics: DataFrame) -> DataFrame:
    return metrics.select("reporting_year").distinct().orderBy("reporting_year")


def _named_boards(boards: DataFrame) -> DataFrame:
    return boards.select("board_number", F.col("name").alias("board_name"), F.col("slug").alias("board_slug"))


def school_list(schools: DataFrame, boards: DataFrame, metrics: DataFrame, year: int, condition: Column | None = None) -> DataFrame:
    """Schools with board, the year's metrics (NULL when not reported) and their latest year."""
    wanted = metrics.filter((F.col("reporting_year") == year) & F.col("school_id").isNotNull()).select(
        "school_id", "reporting_year", "eui", "eui_percentile", "peer_count", "peer_q25_eui", "peer_median_eui", "peer_q75_eui",
        "opportunity_score", "score_confidence",
    )
    newest = metrics.filter("school_id is not null").groupBy("school_id").agg(F.max("reporting_year").alias("latest_year"))
    rows = (
        schools.join(_named_boards(boards), "board_number")
        .join(wanted, "school_id", "left")
        .join(newest, "school_id", "left")
    )
    return rows if condition is None else rows.filter(condition)


def in_order(rows: DataFrame, sort: str = "name", descending: bool = False) -> DataFrame:
    """The whole list in order; missing values come last in both directions, ties by name, then slug."""
    column = F.col(SORTS[sort])
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return rows.orderBy(order, F.col("name"), F.col("slug"))


def page(rows: DataFrame, sort: str = "name", descending: bool = False, number: int = 1, size: int = 25) -> DataFrame:
    """One page of the ordered list. Spark keeps only offset + limit rows per task, so no task sorts the whole list."""
    return in_order(rows, sort, descending).offset((number - 1) * size).limit(size)


class PageIndex:
    """A list laid out in order, so that any page of it is read from the parts that hold it.

    Parts are ranges of the order, written as partitions of a table, with their row counts; a page skips all others, however deep it lies,
    and sorts one or two parts. Equal values are dealt over parts by name and slug, so a common value is no single part.
    """

    def __init__(self, rows: DataFrame, sort: str = "name", descending: bool = False):
        column = F.col(SORTS[sort])
        self.order = [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col("name").asc(), F.col("slug").asc()]
        spark = rows.sparkSession
        path = scratch_folder(spark, "pages") + "/rows"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number given is not merged again
        laid = rows.repartitionByRange(parts, *self.order).withColumn("_part", F.spark_partition_id())
        laid.write.partitionBy("_part").parquet(path)
        self.rows = spark.read.schema(laid.schema).parquet(path)
        counts = self.rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one number a partition
        self.parts, self.ends = [r["_part"] for r in counts], list(accumulate(r["n"] for r in counts))

    def page(self, number: int = 1, size: int = 25) -> DataFrame:
        """One page, numbered from 1; the same rows as ``page`` gives."""
        first = (number - 1) * size
        begin, end = bisect_right(self.ends, first), bisect_right(self.ends, first + size - 1)
        skipped = self.ends[begin - 1] if begin else 0
        held = self.rows.filter(F.col("_part").isin(self.parts[begin : end + 1])).drop("_part")
        return held.orderBy(*self.order).offset(first - skipped).limit(size)


def _excluded() -> Column:
    return ~plausible(F.col("data_quality_flags"))


def aggregate_eui() -> Column:
    """Energy per area over plausible records that report both, as an aggregate."""
    counted = plausible(F.col("data_quality_flags")) & (F.col("floor_area_m2") > 0) & F.col("total_site_energy_gj").isNotNull()
    return F.try_divide(F.sum(F.when(counted, F.col("total_site_energy_gj"))), F.sum(F.when(counted, F.col("floor_area_m2"))))


def _totals() -> list[Column]:
    good = plausible(F.col("data_quality_flags"))
    return [
        F.count("*").alias("facilities"),
        F.sum(F.when(good, F.col("total_site_energy_gj"))).alias("total_energy_gj"),
        F.sum(F.when(good, F.col("ghg_kg_co2e"))).alias("total_ghg_kg"),
        F.count_if(_excluded()).alias("excluded_implausible"),
    ]


def yearly_totals(energy: DataFrame) -> DataFrame:
    return energy.groupBy(F.col("reporting_year").alias("year")).agg(*_totals())


def benchmarked_schools(metrics: DataFrame) -> DataFrame:
    return metrics.filter("school_id is not null and operation_category = 'school' and eui is not null")


def _median_eui(rows: DataFrame, keys: list[str]) -> DataFrame:
    return exact_quantiles(rows, keys, F.col("eui"), {"median_eui": 0.5}).withColumnRenamed("n", "schools")


def home_stats(schools: DataFrame, energy: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: latest year, benchmarked schools and boards, median EUI, facilities, energy, span."""
    year = latest_year(metrics)
    rows = (
        metrics.filter((F.col("reporting_year") == year) & F.col("eui").isNotNull())
        .join(schools.select("school_id", "board_number"), "school_id")
        .withColumn("latest_year", F.lit(year))
    )
    counts = rows.groupBy("latest_year").agg(F.count("*").alias("benchmarked_schools"), F.count_distinct("board_number").alias("boards"))
    median = _median_eui(rows, ["latest_year"]).drop("schools")
    latest = F.col("reporting_year") == year
    span = energy.agg(
        F.count_if(latest).alias("reporting_facilities"),
        F.sum(F.when(latest & plausible(F.col("data_quality_flags")), F.col("total_site_energy_gj"))).alias("total_energy_gj"),
        F.min("reporting_year").alias("first_year"),
        F.count_distinct("reporting_year").alias("years_of_data"),
    ).withColumn("latest_year", F.lit(year))
    return counts.join(median, "latest_year").join(span, "latest_year")


def overview_by_year(energy: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals of all reporting facilities beside the median EUI of benchmarked schools."""
    medians = _median_eui(benchmarked_schools(metrics), ["reporting_year"]).withColumnRenamed("reporting_year", "year")
    return yearly_totals(energy).join(medians, "year", "left")


def overview_by(metrics: DataFrame, year: int, keys: list[str], schools: DataFrame | None = None, boards: DataFrame | None = None) -> DataFrame:
    """Benchmarked schools and median EUI of one year per level, region or board."""
    rows = benchmarked_schools(metrics).filter(F.col("reporting_year") == year)
    if schools is not None:
        rows = rows.join(schools.select("school_id", "region", "board_number"), "school_id")
    if boards is not None:
        rows = rows.join(_named_boards(boards), "board_number")
    return _median_eui(rows, keys)


def distribution_quantiles(metrics: DataFrame, year: int) -> DataFrame:
    rows = benchmarked_schools(metrics).filter(F.col("reporting_year") == year)
    return exact_quantiles(rows, ["reporting_year"], F.col("eui"), {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})


def map_points(schools: DataFrame, boards: DataFrame, metrics: DataFrame, year: int) -> DataFrame:
    """Located schools with an EUI in the year (closed schools included)."""
    wanted = metrics.filter((F.col("reporting_year") == year) & F.col("eui").isNotNull()).select(
        "school_id", "eui", F.col("eui_percentile").alias("percentile"), F.col("opportunity_score").alias("score"), "ghg_intensity"
    )
    return (
        schools.dropna(subset=["latitude", "longitude"])
        .join(_named_boards(boards), "board_number")
        .join(wanted, "school_id")
        .select(
            "slug", "name", "city", "region", "school_level", "board_name", "board_slug", "latitude", "longitude",
            "eui", "percentile", "score", "ghg_intensity",
        )
    )


def geojson_features(points: DataFrame, metric: str) -> DataFrame:
    """One GeoJSON feature text per point; ``value`` is the chosen metric or -1."""
    properties = [F.col(c) for c in points.columns] + [F.coalesce(F.col(metric).cast("double"), F.lit(-1.0)).alias("value")]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return points.select("slug", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def bands(df: DataFrame, metric: str, value: Column) -> DataFrame:
    """Three rows (tone, min, max): fixed thirds for percentile and score, else tertiles of the values."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null")
    edges = rows.agg(F.least(F.lit(0.0), F.min("v")).alias("lo"), F.greatest(F.lit(100.0), F.max("v")).alias("hi"))
    if metric in ("percentile", "score"):
        cuts = edges.withColumn("a", F.lit(33.3)).withColumn("b", F.lit(66.7))
    else:
        tertiles = exact_quantiles(rows, [], F.col("v"), {"a": 1 / 3, "b": 2 / 3})
        cuts = edges.join(tertiles, F.lit(True), "left").fillna(0.0, ["a", "b"])  # one row each

    def band(tone: str, low: str, high: str) -> Column:
        return F.struct(F.lit(tone).alias("tone"), F.col(low).alias("min"), F.col(high).alias("max"))

    return cuts.select(F.explode(F.array(band("low", "lo", "a"), band("mid", "a", "b"), band("high", "b", "hi"))).alias("b")).select("b.*")


def band_of(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "low").when(value < high, "mid").when(value.isNotNull(), "high")


def board_schools(schools: DataFrame, metrics: DataFrame, year: int) -> DataFrame:
    """Active schools of every board with the year's metrics."""
    wanted = metrics.filter((F.col("reporting_year") == year) & F.col("school_id").isNotNull()).select(
        "school_id", "eui", F.col("eui_percentile").alias("percentile"), F.col("opportunity_score").alias("score"), "score_confidence"
    )
    return schools.filter("active").join(wanted, "school_id", "left").select(
        "board_number", "slug", "name", "city", "school_level", "latitude", "longitude", "eui", "percentile", "score", "score_confidence"
    )


def board_yearly(energy: DataFrame, facilities: DataFrame) -> DataFrame:
    """Totals per board and year over every reporting facility, matched or not."""
    rows = energy.join(facilities.filter("board_number is not null").select("facility_id", "board_number"), "facility_id")
    return rows.groupBy("board_number", F.col("reporting_year").alias("year")).agg(*_totals(), aggregate_eui().alias("aggregate_eui"))


def board_profiles(schools: DataFrame, boards: DataFrame, metrics: DataFrame, year: int) -> DataFrame:
    """Per board: active schools, benchmarked ones, median EUI and score of the year."""
    listed = board_schools(schools, metrics, year).groupBy("board_number").agg(
        F.count("*").alias("schools"), F.count("eui").alias("benchmarked")
    )
    rows = (
        metrics.filter((F.col("reporting_year") == year) & F.col("eui").isNotNull())
        .join(schools.select("school_id", "board_number"), "school_id")
    )
    eui = exact_quantiles(rows, ["board_number"], F.col("eui"), {"median_eui": 0.5}).drop("n")
    score = exact_quantiles(rows, ["board_number"], F.col("opportunity_score").cast("double"), {"median_score": 0.5}).drop("n")
    return (
        boards.select("board_number", "slug", "name", F.lit(year).alias("latest_year"))
        .join(listed, "board_number", "left")
        .join(eui, "board_number", "left")
        .join(score, "board_number", "left")
        .fillna(0, ["schools", "benchmarked"])
    )


def coverage(energy: DataFrame, facilities: DataFrame) -> DataFrame:
    """(section, label, n): records per year, facilities per match status, flagged records."""
    flags = F.col("data_quality_flags")
    by_year = energy.groupBy(F.col("reporting_year").cast("string").alias("label")).agg(F.count("*").alias("n"))
    by_status = facilities.groupBy(F.col("match_status").alias("label")).agg(F.count("*").alias("n"))
    flagged = energy.agg(F.count_if(F.size(flags) > 0).alias("flagged"), F.count_if(_excluded()).alias("implausible"))
    pairs = flagged.select(
        F.explode(
            F.array(
                F.struct(F.lit("flagged").alias("label"), F.col("flagged").alias("n")),
                F.struct(F.lit("implausible").alias("label"), F.col("implausible").alias("n")),
            )
        ).alias("p")
    ).select("p.label", "p.n")

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), "label", "n")

    return section("year", by_year).unionByName(section("status", by_status)).unionByName(section("records", pairs))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at")).limit(1)


def distinct_options(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).dropna().distinct().orderBy(*columns)


def statistics_export(home: DataFrame, by_year: DataFrame, by_level: DataFrame, covered: DataFrame) -> DataFrame:
    """(section, json): the published statistics, one JSON text per row of each part."""

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))

    return part("home", home).unionByName(part("year", by_year)).unionByName(part("level", by_level)).unionByName(part("coverage", covered))



"""Data-quality checks: one count per rule, one report."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(df: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key has no parent; a NULL key has none."""
    return df.join(parents.select(*on).distinct(), list(on), "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def _school_counts(schools: DataFrame, boards: DataFrame) -> DataFrame:
    """One row of counts, from one scan of each table."""
    known = boards.select("board_number").distinct().withColumn("_known", F.lit(True))
    outside = ~(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    numbers = schools.join(known, "board_number", "left").groupBy("school_number").agg(
        F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("no_board"), F.count_if(outside).alias("outside"), F.count_if(F.col("latitude").isNotNull()).alias("located")
    )
    return numbers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("no_board", "outside", "located")], F.count_if(F.col("n") > 1).alias("same_number"))


def _record_counts(facilities: DataFrame, energy: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row of counts, from one scan of each table.

    Facilities and energy records meet in one grouping by facility, whose schools and years then meet the metrics in one grouping by school and year; counts
    travel along as rows without a school. A group keeps distinct years and schools only.
    """
    matched, linked = F.col("match_status") == "matched", F.col("school_id").isNotNull()
    none = F.lit(None)
    of_facility = facilities.select(
        "facility_id", "school_id", none.cast("int").alias("reporting_year"), F.lit(0).cast("long").alias("records"),
        (matched & ~linked).alias("unlinked"), (~matched & linked).alias("unmatched"), (~F.col("match_confidence").between(0, 1)).alias("unsure"),
    )
    no = F.lit(False)
    of_record = energy.groupBy("facility_id", "reporting_year").agg(F.count("*").alias("records")).select(
        "facility_id", none.cast(facilities.schema["school_id"].dataType).alias("school_id"), F.col("reporting_year").cast("int").alias("reporting_year"), "records", no.alias("unlinked"), no.alias("unmatched"), no.alias("unsure"),
    )
    named = F.col("facility_id").isNotNull()
    by_facility = of_facility.unionByName(of_record).groupBy("facility_id").agg(
        F.sum("records").alias("records"), F.count_if(F.col("records") > 1).alias("repeated"), F.sum(F.when(~F.col("reporting_year").between(2000, 2100), F.col("records"))).alias("odd_years"),
        *[F.count_if(c).alias(c) for c in ("unlinked", "unmatched", "unsure")], F.collect_set(F.when(named, F.col("reporting_year"))).alias("years"), F.collect_set(F.when(named, F.col("school_id"))).alias("schools"),
    )
    counted = ["records", "repeated", "odd_years", "unlinked", "unmatched", "unsure"]
    own = ["few_peers", "odd_score", "two_owners"]
    pairs = F.flatten(F.transform("schools", lambda s: F.transform("years", lambda y: F.struct(s.alias("school_id"), y.alias("reporting_year")))))
    no_pair = F.array(F.struct(none.cast(facilities.schema["school_id"].dataType).alias("school_id"), none.cast("int").alias("reporting_year")))
    reported = by_facility.select(*counted, F.posexplode(F.concat(no_pair, pairs)).alias("at", "pair")).select(
        "pair.*", (F.col("at") > 0).alias("reported"), no.alias("known"), *[F.when(F.col("at") == 0, F.col(c)).otherwise(0).cast("long").alias(c) for c in counted], *[F.lit(0).cast("long").alias(c) for c in own]
    )
    score = F.col("opportunity_score")
    flags = {"few_peers": score.isNotNull() & (F.col("peer_count") < 10), "odd_score": ~score.between(0, 100), "two_owners": F.col("school_id").isNull() == F.col("facility_id").isNull()}
    measured = metrics.select(
        "school_id", F.col("reporting_year").cast("int").alias("reporting_year"), no.alias("reported"), F.col("school_id").isNotNull().alias("known"),
        *[F.lit(0).cast("long").alias(c) for c in counted], *[F.coalesce(flag, no).cast("long").alias(name) for name, flag in flags.items()],
    )
    by_year = reported.unionByName(measured).groupBy("school_id", "reporting_year").agg(
        F.max("reported").alias("reported"), F.max("known").alias("known"), *[F.sum(c).alias(c) for c in (*counted, *own)]
    )
    return by_year.agg(F.count_if(F.col("reported") & ~F.col("known")).alias("unmeasured"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*counted, *own)])


def standard_checks(
    boards: DataFrame, schools: DataFrame, facilities: DataFrame, energy: DataFrame, metrics: DataFrame
) -> DataFrame:
    """The whole report (name, count, expect_zero, ok, all_ok) in one job that reads each table once."""
    rules = [
        ("Matched facilities without a school", "unlinked", True),
        ("School set without a match", "unmatched", True),
        ("Schools pointing at a missing board", "no_board", True),
        ("Duplicate facility-years", "repeated", True),
        ("Scores outside 0–100", "odd_score", True),
        ("Scores shown with fewer than 10 peers", "few_peers", True),
        ("Metrics without exactly one of school and facility", "two_owners", True),
        ("Matched facility-years missing from peer metrics", "unmeasured", True),
        ("Coordinates out of range", "outside", True),
        ("Match confidence outside 0..1", "unsure", True),
        ("Reporting years outside 2000..2100", "odd_years", True),
        ("Duplicate school numbers", "same_number", True),
        ("Energy records", "records", False),
        ("Schools with coordinates", "located", False),
    ]
    counts = _school_counts(schools, boards).crossJoin(_record_counts(facilities, energy, metrics))  # one row each
    lines = F.array(
        *[F.struct(F.lit(name).alias("name"), F.col(c).cast("long").alias("count"), F.lit(zero).alias("expect_zero"), ((F.col(c) == 0) == F.lit(zero)).alias("ok")) for name, c, zero in rules]
    )
    return counts.select(F.explode(F.transform(lines, lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"), x["expect_zero"].alias("expect_zero"), x["ok"].alias("ok"), F.forall(lines, lambda y: y["ok"]).alias("all_ok")))).alias("l")).select("l.*")

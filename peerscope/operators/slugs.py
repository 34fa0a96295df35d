"""Slugs that stay unique: every item of a shared base slug gets its longer fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.text import slugify


def unique_slugs(df: DataFrame, base: Sequence[Column], fallback: Sequence[Column], name: str = "slug") -> DataFrame:
    """Shared bases are counted by a map-side combined aggregate and joined back.

    A window would bring all items of one base into one task.
    """
    named = df.withColumn("_base", slugify(*base)).withColumn("_long", slugify(*fallback))
    shared = named.groupBy("_base").agg(F.count("*").alias("_n")).filter("_n > 1")
    joined = named.join(shared, "_base", "left")
    return joined.withColumn(name, F.when(F.col("_n").isNull(), F.col("_base")).otherwise(F.col("_long"))).drop("_base", "_long", "_n")

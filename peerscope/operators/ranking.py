"""Exact order statistics and running sums that never hold one group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer and a window over a
group sorts it in one task; both fail when one group holds a third of a large table. Here equal values
are counted on the map side, the counted values are laid out by a range partitioning over (group,
value), counts are summed inside each partition and shifted by the totals of the partitions
before. Quantiles, ranks, deviations and histograms are read from that one stored table, so the
input is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.units import finite
from peerscope.session import materialize


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_{key}"])
    return condition


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys meet; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    return left.join(renamed, _same(left, renamed, keys), how).drop(*[f"_{k}" for k in keys])


def _per_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a table with one row per key; without keys that is a single row."""
    return join_null_safe(left, right, keys) if keys else left.join(right, F.lit(True))


def ranked_values(df: DataFrame, keys: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    """Distinct finite values per key: keys, ``_v``, ``_c`` (rows with it), ``_to`` (rows up to it); a stored table, as it is read several times."""
    rows = df.select(*keys, finite(value).alias("_v"), (F.lit(1) if weight is None else weight).alias("_w")).filter("_v is not null")
    counted = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    return materialize(running_sum(counted, keys, ["_v"], "_c", "_to"))


def quantiles_of(ranked: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], interpolate: bool = True) -> DataFrame:
    """``exact_quantiles`` of a table of ``ranked_values``."""
    keys = list(keys)
    placed = _per_key(ranked, ranked.groupBy(*keys).agg(F.max("_to").alias("n")), keys)
    picks = []
    for name, q in quantiles.items():
        position = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(position), F.ceil(position)
        for end, index in (("lo", low), ("hi", high)):
            picks.append(F.max(F.when((F.col("_to") - F.col("_c") <= index) & (F.col("_to") > index), F.col("_v"))).alias(f"{name}_{end}"))
    picked = placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks).filter("n is not null")

    def result(name: str, q: float) -> Column:
        position = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return (low + (high - low) * (position - F.floor(position)) if interpolate else low).alias(name)

    return picked.select(*keys, "n", *[result(name, q) for name, q in quantiles.items()])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, quantiles: Mapping[str, float], interpolate: bool = True
) -> DataFrame:
    """One row per key: ``n`` finite values and each named quantile.

    ``interpolate`` gives type-7 quantiles; without it the value at floor(q (n - 1)) is returned.
    """
    return quantiles_of(ranked_values(df, keys, value), keys, quantiles, interpolate)


def exact_mad(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Median, median absolute deviation and mean absolute deviation per key."""
    keys = list(keys)
    ranked = ranked_values(df, keys, value)
    centers = materialize(quantiles_of(ranked, keys, {"median": 0.5}))
    distance = _per_key(ranked.select(*keys, "_v", "_c"), centers, keys).withColumn("_d", F.abs(F.col("_v") - F.col("median")))
    mads = exact_deviations(distance, keys)
    return _per_key(centers, mads, keys)


def exact_deviations(distance: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and mean of weighted distances (``_d`` with ``_c`` rows each) per key."""
    ranked = ranked_values(distance, keys, F.col("_d"), F.col("_c"))
    means = ranked.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_ad"))
    return _per_key(quantiles_of(ranked, keys, {"mad": 0.5}).drop("n"), means, keys)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` within each key, ordered by ``order``.

    (key, order) must be unique. The layout is checkpointed once, because offsets and rows must
    come from the same partitioning even when an executor is lost in between.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    laid = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    laid = materialize(laid.withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, "_part")
        .agg(F.sum(weight).alias("_t"))
        .select(*keys, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    )
    local_sum = laid.withColumn("_run", F.sum(weight).over(local))
    return (
        join_null_safe(local_sum, offsets, [*keys, "_part"])
        .withColumn(name, F.col("_run") + F.col("_offset"))
        .drop("_run", "_offset", "_part")
    )


def group_percentile_ranks(df: DataFrame, keys: Sequence[str], value: Column, name: str = "percentile") -> DataFrame:
    """Percentile rank of each row among the other rows of its group (ties count half).

    Returns keys, the value and its rank once per distinct value; join it back where rows are needed.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, finite(value).alias("value"))
        .filter("value is not null")
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("ties"))
    )
    ranked = running_sum(counted, keys, ["value"], "ties", "_to")
    totals = ranked.groupBy(*keys).agg(F.sum("ties").alias("n"))
    below, others = F.col("_to") - F.col("ties"), F.col("n") - 1
    rank = F.try_divide(below + 0.5 * (F.col("ties") - 1), others) * 100
    joined = join_null_safe(ranked, totals, keys) if keys else ranked.join(totals, F.lit(True))
    return joined.select(*keys, "value", "ties", "n", rank.alias(name))


def equal_width_bins(
    df: DataFrame, keys: Sequence[str], value: Column, bins: int = 24, clip: float = 0.99
) -> DataFrame:
    """Histogram per key: equal widths from 0 to the clipped maximum plus one open-ended bin.

    Rows: key, bin, from, to, count, open_ended. Negative values are dropped; a group of zeros gets
    a single bin; empty bins are listed with count 0.
    """
    keys = list(keys)
    ranked = ranked_values(df.filter(finite(value) >= 0), keys, value)
    ceilings = quantiles_of(ranked, keys, {"_ceiling": clip}, interpolate=False)
    ranges = _per_key(ceilings, ranked.groupBy(*keys).agg(F.max("_v").alias("_max")), keys)
    placed = _per_key(ranked, ranges, keys)
    width = F.col("_ceiling") / bins
    slot = (
        F.when(F.col("_ceiling") == 0, F.lit(0))
        .when(F.col("_v") > F.col("_ceiling"), F.lit(bins))
        .otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_v"), width)).cast("int")))
    )
    # a zero ceiling keeps everything in one closed bin, larger values included
    counts = placed.groupBy(*keys, slot.alias("bin")).agg(F.sum("_c").alias("count"))
    grid = ranges.select(
        *keys, "_ceiling", "_max", F.explode(F.when(F.col("_ceiling") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins)))).alias("bin")
    )
    full = join_null_safe(grid, counts, [*keys, "bin"], "left")
    overflow = F.col("bin") == bins
    return full.filter(~overflow | (F.col("count") > 0)).select(
        *keys,
        "bin",
        F.when(overflow, F.col("_ceiling")).otherwise(F.col("bin") * width).alias("from"),
        F.when(overflow, F.col("_max")).otherwise((F.col("bin") + 1) * width).alias("to"),
        F.coalesce("count", F.lit(0)).alias("count"),
        overflow.alias("open_ended"),
    )

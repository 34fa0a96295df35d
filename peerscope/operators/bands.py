"""Peer candidates of every stage, counted without forming pairs: band counts over floor area and weekly hours.

Ordered by floor area, an area band is a range of positions in its pool, and the hours band cuts a second range out of it. Both bounds of
every band are laid among the peers by one range-partitioned running sum, which gives positions for pools of any size. Peers in a
rectangle of positions and hours are four counts of peers below a corner, and those are counted digit by digit: at each binary digit of
the corner's position that is one, the peers that agree with it so far and have a zero there are one chunk of the area order; the
cumulative count of a chunk's peers over their hours, read at the corner's hours, is that chunk's share. All chunks of all
sizes are cumulated together by one more running sum. So a pool is never one task, nothing is collected, there is no step per
distinct value, and the rows grow as n log n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.stats import MIN_PEERS, PREFERRED_PEERS
from peerscope.operators.cohort import HOURS_TOLERANCE, POOL_KEYS, STAGES, pool_rows
from peerscope.operators.ranking import running_sum
from peerscope.session import materialize

#: The area bands by their limits, in the order of the stages that use them; the last one has none.
SPANS = tuple(dict.fromkeys(span for _, span, _ in STAGES if span))
COUNTS = [f"stage{k}_peers" for k in range(len(STAGES))]


def _edge(start: np.ndarray, inside, outwards: float) -> np.ndarray:
    """The last double, seen from inside, that still fits; ``start`` is a few units in the last place off at most."""
    for _ in range(4):
        further = np.nextafter(start, outwards)
        start = np.where(inside(further), further, start)
    for _ in range(4):
        start = np.where(inside(start), start, np.nextafter(start, -outwards))
    return start


def _limits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for area, hours in batches:
        a, h, found = area.to_numpy(dtype=float), hours.to_numpy(dtype=float), {}
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (low, high) in enumerate(SPANS):
                found[f"low{k}"] = _edge(a * low, lambda x, low=low: x / a >= low, -np.inf)
                found[f"high{k}"] = _edge(a * high, lambda x, high=high: x / a <= high, np.inf)
            found["least_hours"] = _edge(h * (1 - HOURS_TOLERANCE), lambda x: (h - x) / h <= HOURS_TOLERANCE, -np.inf)
            found["most_hours"] = _edge(h * (1 + HOURS_TOLERANCE), lambda x: (x - h) / h <= HOURS_TOLERANCE, np.inf)
        yield pd.DataFrame(found)


LIMITS_DDL = ", ".join([*(f"{end}{k} double" for k in range(len(SPANS)) for end in ("low", "high")), "least_hours double", "most_hours double"])


def limits(area: Column, hours: Column) -> Column:
    """A struct of every band's least and greatest floor area and hours, decided by the very divisions that define the bands."""
    return F.pandas_udf(_limits, LIMITS_DDL)(area, hours)


def below(points: DataFrame, corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, side, n): how many points (keys, id, place, value) lie below each corner (keys, id, side, place, value, equal).

    Places of points are 0, 1, 2, ... within their keys. A point lies below if its place is less than the corner's and its value is less,
    or is not greater where ``equal`` is true. Corners below which nothing lies have no row.
    """
    size = points.agg(F.max("place")).first()[0]
    bits = 0 if size is None else int(size + 1).bit_length()
    levels = F.array(*[F.lit(k) for k in range(bits)]).cast("array<int>")
    zeros = F.filter(levels, lambda k: F.call_function("shiftright", "place", k).bitwiseAND(1) == 0)
    ones = F.filter(levels, lambda k: F.call_function("shiftright", "place", k).bitwiseAND(1) == 1)
    chunk = F.call_function("shiftright", "place", F.col("level") + 1).alias("chunk")
    side, one, none = F.lit(None).cast("int").alias("side"), F.lit(1).cast("long").alias("one"), F.lit(0).cast("long").alias("one")
    inner = points.select(*keys, "place", "value", "id", F.explode(zeros).alias("level")).select(*keys, "level", chunk, "value", F.lit(1).alias("kind"), "id", side, one)
    outer = corners.select(*keys, "place", "value", "id", "side", F.when(F.col("equal"), 2).otherwise(0).alias("kind"), F.explode(ones).alias("level"))
    rows = inner.unionAll(outer.select(*keys, "level", chunk, "value", "kind", "id", "side", none))
    counted = running_sum(rows, [*keys, "level", "chunk"], ["value", "kind", "id", "side"], "one", "n")
    return counted.filter("side is not null").groupBy("id", "side").agg(F.sum("n").alias("n"))


def stage_counts(entities: DataFrame, usable: Column) -> DataFrame:
    """One row per entity-year with an EUI: entity_key, reporting_year, the peers of each stage, peer_stage (-1: none), peer_count.

    Stages are those of ``cohort.STAGES``; an entity without weekly hours has null for the stages that compare them. The first stage with the
    preferred number of peers is chosen, else the first with the least one. Entities are no peers of their own.
    """
    rows = pool_rows(entities, usable).withColumn("id", F.monotonically_increasing_id()).withColumn("pool", F.xxhash64(*POOL_KEYS))
    rows = materialize(rows.select("id", "pool", "entity_key", "reporting_year", "floor_area_m2", "weekly_hours", "is_peer", "is_target"))
    hours = F.when(F.col("weekly_hours") > 0, F.col("weekly_hours"))
    targets = materialize(rows.filter("is_target").withColumn("at", limits(F.col("floor_area_m2"), hours)).select("*", "at.*").drop("at"))
    peers = rows.filter("is_peer")
    # positions: a lower bound stands before the peers with just that area, an upper one behind them
    ends = [F.struct(F.lit(2 * k + up).alias("side"), F.col(f"{'high' if up else 'low'}{k}").alias("value"), F.lit(2 * up).alias("kind")) for k in range(len(SPANS)) for up in (0, 1)]
    ends.append(F.struct(F.lit(2 * len(SPANS)).alias("side"), F.lit(float("inf")).alias("value"), F.lit(2).alias("kind")))
    laid = peers.select("pool", F.col("floor_area_m2").alias("value"), F.lit(1).alias("kind"), "id", F.lit(None).cast("int").alias("side"), F.lit(1).cast("long").alias("one"))
    asked = targets.select("pool", "id", F.explode(F.array(*ends)).alias("end")).select("pool", "end.value", "end.kind", "id", "end.side", F.lit(0).cast("long").alias("one"))
    placed = materialize(running_sum(laid.unionAll(asked), ["pool"], ["value", "kind", "id", "side"], "one", "place"))
    found = placed.filter("side is not null").groupBy("id").agg(*[F.max(F.when(F.col("side") == k, F.col("place"))).alias(f"place{k}") for k in range(2 * len(SPANS) + 1)])
    targets = materialize(targets.join(found, "id"))
    points = placed.filter("side is null").select("id", (F.col("place") - 1).alias("place")).join(peers.filter("weekly_hours is not null").select("id", "pool", F.col("weekly_hours").alias("value")), "id")
    corners = [
        F.struct(F.lit(2 * right + top).alias("side"), F.col(f"place{int(right)}").alias("place"), F.col("most_hours" if top else "least_hours").alias("value"), F.lit(bool(top)).alias("equal"))
        for right in (0, 1) for top in (0, 1)
    ]
    asked = targets.filter("weekly_hours > 0").select("pool", "id", F.explode(F.array(*corners)).alias("c")).select("pool", "id", "c.*")
    sign = F.when(F.col("side").isin(0, 3), F.col("n")).otherwise(-F.col("n"))
    inside = below(points, asked, ["pool"]).groupBy("id").agg(F.sum(sign).alias("with_hours"))
    own = F.col("is_peer").cast("long")
    by_span = {span: F.col(f"place{2 * k + 1}") - F.col(f"place{2 * k}") - own for k, span in enumerate(SPANS)} | {None: F.col(f"place{2 * len(SPANS)}") - own}
    counted = targets.join(inside, "id", "left").select(
        "entity_key", "reporting_year",
        *[(F.when(F.col("weekly_hours") > 0, F.coalesce("with_hours", F.lit(0)) - own) if by_hours else by_span[span]).alias(name) for name, (_, span, by_hours) in zip(COUNTS, STAGES, strict=True)],
    )
    stage = F.lit(-1)
    for least in (MIN_PEERS, PREFERRED_PEERS):
        for k in range(len(STAGES) - 1, -1, -1):
            stage = F.when(F.col(COUNTS[k]) >= least, k).otherwise(stage)
    chosen = counted.withColumn("peer_stage", stage)
    count = F.lit(0).cast("long")
    for k, name in enumerate(COUNTS):
        count = F.when(F.col("peer_stage") == k, F.col(name)).otherwise(count)
    return chosen.withColumn("peer_count", count)

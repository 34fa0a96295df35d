"""Cohort statistics of one pool that is too large for a task.

Peers are cut into slices of consecutive EUI ranks, targets into tiles; both have a bounded size
and every (slice, tile) pair is its own task. Counts add up over slices, so stages and percentile
ranks need one pass. An order statistic lies in the one slice where the running count passes its
position, so it is looked up there. The median deviation is found by narrowing the radius around the
median until no double lies between its bounds. Nothing is sampled and no peer pair is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.stats import MEAN_AD_SCALE, MAD_SCALE, MIN_PEERS, PREFERRED_PEERS
from peerscope.operators.cohort import (
    CLIP,
    HISTOGRAM_BINS,
    HISTOGRAM_SCHEMA,
    HOURS_TOLERANCE,
    STAGES,
    Cohorts,
    RangeRanks,
    _area_bounds,
    bin_thresholds,
    histogram_rows,
)
from peerscope.operators.ranking import running_sum
from peerscope.session import materialize

_PEER = "entity_key string, floor_area_m2 double, weekly_hours double, eui double, ghg_intensity double, slice long"
_MEASURES = 6  # peers, peers below, peers equal; the same three for emissions
_PROBES = 63


def _in_slice(peers: pd.DataFrame, targets: pd.DataFrame, stage: int):
    """Yield (target positions, peer sub-sequence, left, right, own) that together cover the targets."""
    area, size = peers["floor_area_m2"].to_numpy(), targets["floor_area_m2"].to_numpy()
    _, span, by_hours = STAGES[stage]
    if span is None:
        left, right = np.zeros(len(targets), dtype=np.int64), np.full(len(targets), len(peers), dtype=np.int64)
    else:
        left, right = _area_bounds(area, size, *span)
    own = pd.Index(peers["entity_key"]).get_indexer(targets["entity_key"])
    if not by_hours:
        yield np.arange(len(targets)), peers, left, right, own
        return
    hours, wanted = peers["weekly_hours"].to_numpy(), targets["weekly_hours"].to_numpy()
    for value in np.unique(wanted[wanted > 0]):
        with np.errstate(invalid="ignore"):
            fits = np.abs(hours - value) / value <= HOURS_TOLERANCE
        shift = np.concatenate([[0], np.cumsum(fits)])
        group = np.flatnonzero(wanted == value)
        mine = np.where((own[group] >= 0) & fits[np.clip(own[group], 0, None)], shift[np.clip(own[group], 0, None)], -1)
        yield group, peers[fits].reset_index(drop=True), shift[left[group]], shift[right[group]], mine


def _ordered(peers: pd.DataFrame) -> pd.DataFrame:
    return peers.sort_values(["floor_area_m2", "entity_key"], kind="stable").reset_index(drop=True)


def _count(key, peers: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    peers = _ordered(peers)
    counts = np.zeros((len(targets), len(STAGES) * _MEASURES), dtype=np.int64)
    eui, ghg = targets["eui"].to_numpy(), targets["ghg_intensity"].to_numpy()
    if len(peers):
        for stage in range(len(STAGES)):
            for group, rows, left, right, own in _in_slice(peers, targets, stage):
                if not len(rows):
                    continue
                at = stage * _MEASURES
                cohort = Cohorts(RangeRanks(rows["eui"].to_numpy()), left, right, own)
                counts[group, at] = cohort.size
                counts[group, at + 1], counts[group, at + 2] = cohort.counts(eui[group])
                values = rows["ghg_intensity"].to_numpy()
                known = ~np.isnan(values)
                if known.any():
                    shift = np.concatenate([[0], np.cumsum(known)])
                    mine = np.where((own >= 0) & known[np.clip(own, 0, None)], shift[np.clip(own, 0, None)], -1)
                    emitters = Cohorts(RangeRanks(values[known]), shift[left], shift[right], mine)
                    below, equal = emitters.counts(np.nan_to_num(ghg[group]))
                    counts[group, at + 3], counts[group, at + 4], counts[group, at + 5] = emitters.size, below, equal
    return pd.DataFrame({"entity_key": targets["entity_key"], "slice": key[0], "counts": pd.Series(list(counts), dtype=object)})


def _select(key, peers: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    peers = _ordered(peers)
    values = np.full(len(asked), np.nan)
    for stage in asked["stage"].unique():
        part = np.flatnonzero(asked["stage"] == stage)
        questions = asked.iloc[part].reset_index(drop=True)
        for group, rows, left, right, own in _in_slice(peers, questions, int(stage)):
            cohort = Cohorts(RangeRanks(rows["eui"].to_numpy()), left, right, own)
            values[part[group]] = cohort.value_at(questions["k"].to_numpy()[group])
    return pd.DataFrame({"entity_key": asked["entity_key"], "name": asked["name"], "found": values})


def _radii(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Probe radii between two bounds given as bit patterns of non-negative doubles."""
    step = np.arange(1, _PROBES + 1)
    width = (high - low)[:, None]
    # low + width * step / (probes + 1) without overflow
    whole, rest = width // (_PROBES + 1), width % (_PROBES + 1)
    return np.minimum(low[:, None] + whole * step + rest * step // (_PROBES + 1), high[:, None])


def _reach(ordered: np.ndarray, center: np.ndarray, radius: np.ndarray, upper: bool) -> np.ndarray:
    """First index beyond the radius above the center (upper), or first index within it below."""
    low, high = np.zeros(len(center), dtype=np.int64), np.full(len(center), len(ordered), dtype=np.int64)
    while np.any(low < high):
        mid = np.minimum((low + high) // 2, len(ordered) - 1)
        value = ordered[mid]
        beyond = (value - center > radius) if upper else (center - value <= radius)
        active = low < high
        high = np.where(active & beyond, mid, high)
        low = np.where(active & ~beyond, mid + 1, low)
    return low


def _within(key, peers: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    peers = _ordered(peers)
    hits = np.zeros((len(asked), _PROBES), dtype=np.int64)
    bits = _radii(asked["low"].to_numpy(), asked["high"].to_numpy())
    radii = np.maximum(bits, 0).view(np.float64)
    for stage in asked["stage"].unique():
        part = np.flatnonzero(asked["stage"] == stage)
        questions = asked.iloc[part].reset_index(drop=True)
        for group, rows, left, right, own in _in_slice(peers, questions, int(stage)):
            if not len(rows):
                continue
            ranks = RangeRanks(rows["eui"].to_numpy())
            center = questions["median"].to_numpy()[group]
            inside = (own >= left) & (own < right)
            mine = np.where(inside, ranks.rank[np.clip(own, 0, None)], -1)
            for probe in range(_PROBES):
                radius = radii[part[group], probe]
                first = _reach(ranks.sorted, center, radius, upper=False)
                last = np.maximum(_reach(ranks.sorted, center, radius, upper=True), first)
                number = ranks.count_below(left, right, last) - ranks.count_below(left, right, first)
                number = number - ((mine >= first) & (mine < last))
                hits[part[group], probe] = np.where(bits[part[group], probe] >= 0, number, 0)
    return pd.DataFrame({"entity_key": asked["entity_key"], "name": asked["name"], "hits": pd.Series(list(hits), dtype=object)})


def _deviation_sum(key, peers: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    peers = _ordered(peers)
    total, nonzero = np.zeros(len(asked)), np.zeros(len(asked), dtype=np.int64)
    for stage in asked["stage"].unique():
        part = np.flatnonzero(asked["stage"] == stage)
        questions = asked.iloc[part].reset_index(drop=True)
        for group, rows, left, right, own in _in_slice(peers, questions, int(stage)):
            median = questions["median"].to_numpy()[group]
            inside = (own >= left) & (own < right)
            for center in np.unique(median):
                i = np.flatnonzero(median == center)
                distance = np.abs(rows["eui"].to_numpy() - center)
                sums = np.concatenate([[0.0], np.cumsum(distance)])
                counts = np.concatenate([[0], np.cumsum(distance > 0)])
                mine = np.where(inside[i], distance[np.clip(own[i], 0, None)], 0.0)
                total[part[group[i]]] = sums[right[i]] - sums[left[i]] - mine
                nonzero[part[group[i]]] = counts[right[i]] - counts[left[i]] - (mine > 0)
    return pd.DataFrame({"entity_key": asked["entity_key"], "total": total, "nonzero": nonzero})


def _own_columns(df: DataFrame) -> DataFrame:
    """The same columns under new ids, since both sides of a cogroup stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class _Slices:
    """Sliced peers that answer bounded batches of questions."""

    def __init__(self, peers: DataFrame, limit: int) -> None:
        self.peers, self.limit = peers, limit

    def ask(self, questions: DataFrame, answer, schema: str, count: int) -> DataFrame:
        """Questions carry ``slice``; ``count`` bounds the questions any slice receives."""
        tiles = max(1, -(-count // self.limit))
        copies = _own_columns(self.peers).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        dealt = _own_columns(questions).withColumn("tile", F.pmod(F.xxhash64("entity_key"), F.lit(tiles)).cast("int"))
        return copies.groupBy("slice", "tile").cogroup(dealt.groupBy("slice", "tile")).applyInPandas(
            lambda key, left, right: answer(key, left, right), schema
        )


def _first_stage(size: list[Column], hours: Column) -> Column:
    stage = F.lit(-1)
    for wanted in (MIN_PEERS, PREFERRED_PEERS):
        for index in range(len(size) - 1, -1, -1):
            fits = size[index] >= wanted
            if STAGES[index][2]:
                fits = fits & F.coalesce(hours > 0, F.lit(False))
            stage = F.when(fits, F.lit(index)).otherwise(stage)
    return stage


@dataclass
class _Staged:
    """A sliced pool whose targets have their stage."""

    slices: _Slices
    edges: DataFrame  # smallest and largest EUI per slice
    targets: DataFrame  # every target with stage, peer_count, below, eui_percentile, ghg_percentile
    spread: DataFrame  # per target with peers and slice: how many of them it holds, and up to there
    number: int


def _stage(rows: DataFrame, limit: int) -> _Staged:
    ranked = running_sum(
        rows.filter("is_peer").select("entity_key", "floor_area_m2", "weekly_hours", "eui", "ghg_intensity", F.lit(1).alias("one")),
        [], ["eui", "entity_key"], "one", "position",
    )
    peers = materialize(
        ranked.withColumn("slice", F.floor((F.col("position") - 1) / limit)).select(*[c.split()[0] for c in _PEER.split(", ")])
    )
    targets = materialize(
        rows.filter("is_target").select("entity_key", "reporting_year", "floor_area_m2", "weekly_hours", "eui", "ghg_intensity")
    )
    edges = peers.groupBy("slice").agg(F.min("eui").alias("smallest"), F.max("eui").alias("largest"))
    number = targets.count()
    slices = _Slices(peers, limit)
    last = ranked.agg(F.max("position")).first()[0] or 1
    every = targets.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit((last - 1) // limit)).cast("array<long>")))
    counted = materialize(slices.ask(every, _count, "entity_key string, slice long, counts array<long>", number))
    width = len(STAGES) * _MEASURES
    summed = counted.groupBy("entity_key").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(width)]).alias("all"))
    staged = targets.join(summed, "entity_key").withColumn(
        "stage", _first_stage([F.col("all")[s * _MEASURES] for s in range(len(STAGES))], F.col("weekly_hours"))
    )

    def measure(i: int) -> Column:
        return F.when(F.col("stage") >= 0, F.get(F.col("all"), F.col("stage") * _MEASURES + i))

    def rank(first: int) -> Column:
        return (measure(first + 1) + 0.5 * measure(first + 2)) / measure(first) * 100

    staged = materialize(
        staged.withColumn("peer_count", F.coalesce(measure(0), F.lit(0)))
        .withColumn("below", measure(1))
        .withColumn("eui_percentile", rank(0))
        .withColumn("ghg_percentile", F.when((measure(3) >= MIN_PEERS) & F.col("ghg_intensity").isNotNull(), rank(3)))
        .drop("all")
    )
    order = Window.partitionBy("entity_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    spread = materialize(
        counted.join(staged.filter("stage >= 0"), "entity_key")
        .withColumn("here", F.get(F.col("counts"), F.col("stage") * _MEASURES))
        .drop("counts")
        .withColumn("upto", F.sum("here").over(order))
        .filter("here > 0")
    )
    return _Staged(slices, edges, staged, spread, number)


def _values_at(pool: _Staged, positions: dict[str, Column]) -> DataFrame:
    """(entity_key, one column per name): the peer value at each position; NULL positions are skipped."""
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in positions.items()])
    here = F.filter(wanted, lambda p: (p["at"] < F.col("upto")) & (p["at"] >= F.col("upto") - F.col("here")))
    asked = (
        pool.spread.withColumn("_w", F.explode(here))
        .withColumn("name", F.col("_w.name"))
        .withColumn("k", F.col("_w.at") - (F.col("upto") - F.col("here")))
        .drop("_w")
    )
    found = pool.slices.ask(asked, _select, "entity_key string, name string, found double", pool.number * len(positions))
    return found.groupBy("entity_key").agg(
        *[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in positions]
    )


def hot_pool_statistics(rows: DataFrame, limit: int) -> DataFrame:
    """The same result rows as ``cohort.benchmark_pool`` for one pool of any size."""
    pool = _stage(rows, limit)
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    position = {name: (F.col("peer_count") - 1) * q for name, q in quartiles.items()}
    ends = {f"{n}a": F.floor(p) for n, p in position.items()} | {f"{n}b": F.ceil(p) for n, p in position.items()}
    by_name = _values_at(pool, ends)

    def interpolated(name: str) -> Column:
        return F.col(f"{name}a") + (F.col(f"{name}b") - F.col(f"{name}a")) * (position[name] - F.floor(position[name]))

    found = materialize(
        pool.targets.filter("stage >= 0").join(by_name, "entity_key").select(
            "entity_key",
            interpolated("q25").alias("peer_q25_eui"),
            interpolated("q50").alias("median"),
            interpolated("q75").alias("peer_q75_eui"),
        )
    )
    about = materialize(pool.spread.join(pool.edges, "slice").join(found.select("entity_key", "median"), "entity_key"))
    mad = _median_deviation(pool.slices, about, pool.number)
    flat = about.join(mad.filter("mad = 0").select("entity_key"), "entity_key")
    sums = (
        pool.slices.ask(flat, _deviation_sum, "entity_key string, total double, nonzero long", pool.number)
        .groupBy("entity_key")
        .agg(F.sum("total").alias("total"), F.sum("nonzero").alias("nonzero"))
    )
    off = F.col("eui") - F.col("median")
    z = (
        F.when(F.col("mad") > 0, MAD_SCALE * off / F.col("mad"))
        .when(F.col("nonzero") > 0, off / (MEAN_AD_SCALE * F.col("total") / F.col("peer_count")))
        .when(off == 0, F.lit(0.0))
    )
    return (
        pool.targets.join(found, "entity_key", "left")
        .join(mad, "entity_key", "left")
        .join(sums, "entity_key", "left")
        .select(
            "entity_key", "reporting_year", F.col("stage").alias("peer_stage"), "peer_count", "eui_percentile",
            "ghg_percentile", "peer_q25_eui", F.col("median").alias("peer_median_eui"), "peer_q75_eui", z.alias("eui_robust_z"),
        )
    )


def _under_edges(key, peers: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Peers below each bin threshold, and up to the ceiling, in one slice."""
    peers = _ordered(peers)
    counts = np.zeros((len(asked), HISTOGRAM_BINS), dtype=np.int64)
    for stage in asked["stage"].unique():
        part = np.flatnonzero(asked["stage"] == stage)
        questions = asked.iloc[part].reset_index(drop=True)
        for group, rows, left, right, own in _in_slice(peers, questions, int(stage)):
            if not len(rows):
                continue
            cohort = Cohorts(RangeRanks(rows["eui"].to_numpy()), left, right, own)
            ceiling = questions["ceiling"].to_numpy()[group]
            edges = bin_thresholds(ceiling)
            for j in range(HISTOGRAM_BINS - 1):
                counts[part[group], j] = cohort.counts(edges[:, j])[0]
            counts[part[group], HISTOGRAM_BINS - 1] = sum(cohort.counts(ceiling))
    return pd.DataFrame({"entity_key": asked["entity_key"], "under": pd.Series(list(counts), dtype=object)})


def _bins_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            under = np.stack(rows["under"].to_numpy())
            value, ceiling, top = (rows[c].to_numpy() for c in ("eui", "ceiling", "top"))
            yield histogram_rows(rows, value, rows["peer_count"].to_numpy(), ceiling, top, under[:, :-1], under[:, -1])


def hot_pool_histograms(rows: DataFrame, limit: int) -> DataFrame:
    """The same result rows as ``cohort.histogram_pool`` for one pool of any size."""
    pool = _stage(rows, limit)
    at = F.floor(F.col("peer_count") * CLIP)
    position = F.when(at < F.col("below"), at).when(at > F.col("below"), at - 1)
    ends = _values_at(pool, {"ceiling": position, "largest": F.col("peer_count") - 1})
    limits = materialize(
        pool.targets.filter("stage >= 0").join(ends, "entity_key", "left").select(
            "entity_key", F.coalesce("ceiling", "eui").alias("ceiling"), F.greatest("largest", "eui").alias("top")
        )
    )
    asked = pool.spread.join(limits, "entity_key")
    under = (
        pool.slices.ask(asked, _under_edges, "entity_key string, under array<long>", pool.number)
        .groupBy("entity_key")
        .agg(F.array(*[F.sum(F.col("under")[i]) for i in range(HISTOGRAM_BINS)]).alias("under"))
    )
    ready = pool.targets.join(limits, "entity_key").join(under, "entity_key")
    return ready.select("entity_key", "reporting_year", "eui", "peer_count", "ceiling", "top", "under").mapInPandas(_bins_of, HISTOGRAM_SCHEMA)


def _median_deviation(slices: _Slices, about: DataFrame, number: int) -> DataFrame:
    """Median of |eui - median| over each target's peers."""

    @F.pandas_udf("double")
    def radius(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy().astype(np.int64).view(np.float64))

    largest = about.agg(F.max(F.greatest(F.col("largest") - F.col("median"), F.col("median") - F.col("smallest")))).first()[0]
    if largest is None:  # no target has a peer group
        return about.select("entity_key", F.lit(0.0).alias("mad")).limit(0)
    top = int(np.array([float(largest)]).view(np.int64)[0])
    half = (F.col("peer_count") - 1) * 0.5
    ends = F.array(
        F.struct(F.lit("a").alias("name"), F.floor(half).cast("long").alias("at")),
        F.struct(F.lit("b").alias("name"), F.ceil(half).cast("long").alias("at")),
    )
    # the answer lies in (low, high]; -1 stands for "below zero"
    state = (
        about.select("entity_key", "peer_count").distinct().select("entity_key", F.explode(ends).alias("_e"))
        .select("entity_key", "_e.*", F.lit(-1).cast("long").alias("low"), F.lit(top).cast("long").alias("high"))
    )
    farthest = F.greatest(F.col("largest") - F.col("median"), F.col("median") - F.col("smallest"))
    nearest = F.greatest(F.lit(0.0), F.col("smallest") - F.col("median"), F.col("median") - F.col("largest"))
    while True:
        state = materialize(state)
        open_left = state.filter(F.col("high") - F.col("low") > 1)
        if open_left.isEmpty():
            break
        bounds = open_left.withColumn("inner", F.when(F.col("low") >= 0, radius(F.greatest(F.col("low"), F.lit(0))))).withColumn("outer", radius("high"))
        rows = about.join(bounds, "entity_key")
        settled = F.coalesce(farthest <= F.col("inner"), F.lit(False))
        base = rows.filter(settled).groupBy("entity_key", "name").agg(F.sum("here").alias("base"))
        undecided = rows.filter(~settled & (nearest <= F.col("outer")))
        hits = (
            slices.ask(undecided, _within, "entity_key string, name string, hits array<long>", 2 * number)
            .groupBy("entity_key", "name")
            .agg(F.array(*[F.sum(F.col("hits")[i]) for i in range(_PROBES)]).alias("hits"))
        )
        joined = state.join(base, ["entity_key", "name"], "left").join(hits, ["entity_key", "name"], "left")

        def probe(step: Column) -> Column:
            whole, rest = F.expr(f"(high - low) div {_PROBES + 1}"), F.expr(f"(high - low) % {_PROBES + 1}")
            return F.least(F.col("low") + whole * step + F.floor(rest * step / (_PROBES + 1)).cast("long"), F.col("high"))

        # 1-based number of the first probe radius that holds enough peers, 0 when none does
        first = F.array_position(
            F.transform("hits", lambda h: h + F.coalesce(F.col("base"), F.lit(0)) > F.col("at")), F.lit(True)
        )
        joined = joined.withColumn("_first", first)
        found = F.col("_first") > 0
        high = F.when(found, probe(F.col("_first"))).otherwise(F.col("high"))
        low = F.when(~found, probe(F.lit(_PROBES))).when(F.col("_first") > 1, probe(F.col("_first") - 1)).otherwise(F.col("low"))
        narrowed = F.col("hits").isNotNull()
        state = joined.select(
            "entity_key", "name", "at",
            F.when(narrowed, low).otherwise(F.col("low")).alias("low"),
            F.when(narrowed, high).otherwise(F.col("high")).alias("high"),
        )
    exact = state.withColumn("value", radius("high")).groupBy("entity_key").agg(
        F.max(F.when(F.col("name") == "a", F.col("value"))).alias("_a"),
        F.max(F.when(F.col("name") == "b", F.col("value"))).alias("_b"),
    )
    position = (F.col("peer_count") - 1) * 0.5
    return (
        about.select("entity_key", "peer_count").distinct().join(exact, "entity_key")
        .select("entity_key", (F.col("_a") + (F.col("_b") - F.col("_a")) * (position - F.floor(position))).alias("mad"))
    )

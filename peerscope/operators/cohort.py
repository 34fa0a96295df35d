"""Peer cohorts: staged selection and robust statistics, without forming peer pairs.

A pool is (year, category, level key). Rows of a pool are ordered by floor area, so every area
stage is one contiguous range of the pool and a peer group is never listed: its size, order
statistics, ranks and deviations are read from rank structures in O(log n) steps per target
(``RangeRanks``), vectorised over all targets of the pool. Work is n log n per pool where a self-join
would be n x peers.

A pool is handled by one task only up to ``pool_limit`` rows, a checked size. Larger pools go
through ``operators.hot_pools``, which cuts them into slices that are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.stats import MAD_SCALE, MEAN_AD_SCALE, MIN_PEERS, PREFERRED_PEERS
from peerscope.session import spread

# --- fixed values: relaxation stages, strictest first: label, area ratio range, hours matched -----
STAGES = (
    ("Floor area 0.67–1.5× and weekly hours within ±25%", (0.67, 1.5), True),
    ("Floor area 0.67–1.5×", (0.67, 1.5), False),
    ("Floor area 0.5–2×", (0.5, 2.0), False),
    ("Floor area 0.33–3×", (0.33, 3.0), False),
    ("Any floor area", None, False),
)
HOURS_TOLERANCE = 0.25
POOL_KEYS = ["reporting_year", "operation_category", "level_key"]
POOL_LIMIT = 2_000_000  # rows that one task answers
SLICE_LIMIT = 1 << 18  # peers and targets that a task of a larger pool takes as data frames, which need many times the bytes
BATCH_PEERS = 1 << 17  # peers of several distinct hours that are answered together
BATCH_TARGETS = 1 << 16  # targets answered together; with the peers in few bytes each, this bounds the memory of a task

RESULT_SCHEMA = (
    "entity_key string, reporting_year int, peer_stage int, peer_count long, eui_percentile double, "
    "ghg_percentile double, peer_q25_eui double, peer_median_eui double, peer_q75_eui double, eui_robust_z double"
)


class _Zeros:
    """How many zeros stand before a position of a sequence of bits: a word of bits and a running count for every 64 of them."""

    def __init__(self, ones: np.ndarray) -> None:
        packed = np.zeros((len(ones) // 64 + 1) * 8, dtype=np.uint8)
        bits = np.packbits(~ones, bitorder="little")  # bits behind the last one stay zero
        packed[: len(bits)] = bits
        if len(ones) % 8:
            packed[len(bits) - 1] &= (1 << len(ones) % 8) - 1
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.total = int(self.before[-1] + np.bitwise_count(self.words[-1]))

    def __getitem__(self, position: np.ndarray) -> np.ndarray:
        word = position >> 6
        below = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class RangeRanks:
    """Rank and select over any contiguous range of a value sequence (a wavelet matrix of a bit and a few per value and level)."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(self.n, dtype=np.int32)
        rank[order] = np.arange(self.n, dtype=np.int32)
        self.rank = rank
        self.levels: list[tuple[int, _Zeros]] = []
        current = rank
        for bit in range(max(1, int(self.n - 1).bit_length()) - 1, -1, -1):
            ones = ((current >> bit) & 1).astype(bool)
            self.levels.append((bit, _Zeros(ones)))
            current = np.concatenate([current[~ones], current[ones]])

    def select(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rank of the k-th smallest (from 0) element at positions [left, right)."""
        found = np.zeros(len(k), dtype=np.int64)
        for bit, zeros in self.levels:
            zl, zr = zeros[left], zeros[right]
            up = k >= zr - zl
            k = np.where(up, k - (zr - zl), k)
            left, right = np.where(up, zeros.total + left - zl, zl), np.where(up, zeros.total + right - zr, zr)
            found |= up.astype(np.int64) << bit
        return found

    def count_below(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many elements at positions [left, right) have a rank below ``rank``."""
        total = np.where(rank >= self.n, right - left, 0)
        inner = rank < self.n
        for bit, zeros in self.levels:
            zl, zr = zeros[left], zeros[right]
            up = ((rank >> bit) & 1) == 1
            total = total + np.where(up & inner, zr - zl, 0)
            left, right = np.where(up, zeros.total + left - zl, zl), np.where(up, zeros.total + right - zr, zr)
        return total


class Cohorts:
    """The peer groups of several targets: ranges of one area-ordered sequence, minus the target."""

    def __init__(self, ranks: RangeRanks, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> None:
        self.ranks, self.left, self.right = ranks, left, right
        self.inside = (own >= left) & (own < right)
        self.size = right - left - self.inside
        self.own_rank = np.where(self.inside, ranks.rank[np.clip(own, 0, ranks.n - 1)], ranks.n)
        self.before_own = ranks.count_below(left, right, self.own_rank)

    def value_at(self, k: np.ndarray) -> np.ndarray:
        """k-th smallest value (from 0) among the peers."""
        k = np.clip(k, 0, np.maximum(self.size - 1, 0))
        k = k + (self.inside & (k >= self.before_own))
        return self.ranks.sorted[self.ranks.select(self.left, self.right, k)]

    def quantile(self, q: float) -> np.ndarray:
        position = (self.size - 1) * q
        low = np.floor(position).astype(np.int64)
        a, b = self.value_at(low), self.value_at(np.ceil(position).astype(np.int64))
        return a + (b - a) * (position - low)

    def counts(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Peers below and peers equal to a value per target."""
        first = np.searchsorted(self.ranks.sorted, value, "left")
        last = np.searchsorted(self.ranks.sorted, value, "right")
        below = self.ranks.count_below(self.left, self.right, first)
        below_or_equal = self.ranks.count_below(self.left, self.right, last)
        own_below = self.inside & (self.own_rank < first)
        own_equal = self.inside & (self.own_rank >= first) & (self.own_rank < last)
        return below - own_below, below_or_equal - below - own_equal

    def percentile_rank(self, value: np.ndarray) -> np.ndarray:
        below, equal = self.counts(value)
        return (below + 0.5 * equal) / np.maximum(self.size, 1) * 100

    def _deviation_at(self, center: np.ndarray, k: np.ndarray) -> np.ndarray:
        """k-th smallest |value - center|: the narrowest window of k + 1 ordered peers around it."""
        low, high = np.zeros_like(k), np.maximum(self.size - 1 - k, 0)
        while np.any(low < high):
            mid = (low + high) // 2
            enough = self.value_at(mid + k) - center >= center - self.value_at(mid)
            active = low < high
            high = np.where(active & enough, mid, high)
            low = np.where(active & ~enough, mid + 1, low)
        # the best window starts where its upper end is the farther one, or one step before
        here = np.maximum(self.value_at(low + k) - center, center - self.value_at(low))
        step = np.maximum(low - 1, 0)
        before = np.maximum(self.value_at(step + k) - center, center - self.value_at(step))
        return np.minimum(here, before)

    def median_deviation(self, center: np.ndarray) -> np.ndarray:
        position = (self.size - 1) * 0.5
        low = np.floor(position).astype(np.int64)
        a = self._deviation_at(center, low)
        odd = position == low
        b = a if np.all(odd) else np.where(odd, a, self._deviation_at(center, np.ceil(position).astype(np.int64)))
        return a + (b - a) * (position - low)


def _area_bounds(area: np.ndarray, target: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions [left, right) with low <= area / target <= high, decided by that very division."""
    start, stop = target * low, target * high
    for _ in range(3):  # a * low is at most a few units in the last place off the true edge
        down = np.nextafter(start, -np.inf)
        start = np.where(down / target >= low, down, start)
        up = np.nextafter(stop, np.inf)
        stop = np.where(up / target <= high, up, stop)
    for _ in range(3):
        start = np.where(start / target < low, np.nextafter(start, np.inf), start)
        stop = np.where(stop / target > high, np.nextafter(stop, -np.inf), stop)
    return np.searchsorted(area, start, "left"), np.searchsorted(area, stop, "right")


def choose_stage(counts: np.ndarray) -> np.ndarray:
    """First stage with the preferred size, else first with the minimum, else -1 (stages in rows)."""
    stage = np.full(counts.shape[1], -1)
    for wanted in (MIN_PEERS, PREFERRED_PEERS):
        for s in range(len(counts) - 1, -1, -1):
            stage = np.where(counts[s] >= wanted, s, stage)
    return stage


class _Answers:
    """Statistics of several targets; ``eui`` and ``ghg`` list the peers in area order."""

    def __init__(self, eui: np.ndarray, ghg: np.ndarray) -> None:
        self.eui, self.ranks = eui, RangeRanks(eui)
        # peers that report emissions form a shorter sequence in the same area order
        self.known = ~np.isnan(ghg)
        self.emitters = RangeRanks(ghg[self.known]) if self.known.any() else None
        self.shift = np.concatenate([[0], np.cumsum(self.known, dtype=np.int32)])

    def statistics(self, value, own_ghg, left, right, own) -> dict[str, np.ndarray]:
        cohort = Cohorts(self.ranks, left, right, own)
        median = cohort.quantile(0.5)
        mad = cohort.median_deviation(median)
        z = np.full(len(value), np.nan)
        spread = mad > 0
        z[spread] = MAD_SCALE * (value[spread] - median[spread]) / mad[spread]
        for center in np.unique(median[~spread]):  # more than half of the peers share one value
            i = np.flatnonzero(~spread & (median == center))
            distance = np.abs(self.eui - center)
            totals = np.concatenate([[0.0], np.cumsum(distance)])
            nonzero = np.concatenate([[0], np.cumsum(distance > 0)])
            off = value[i] - center
            others = nonzero[right[i]] - nonzero[left[i]] - (cohort.inside[i] & (off != 0))
            mean_ad = (totals[right[i]] - totals[left[i]] - cohort.inside[i] * np.abs(off)) / cohort.size[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                z[i] = np.where(others > 0, off / (MEAN_AD_SCALE * mean_ad), np.where(off == 0, 0.0, np.nan))
        percentile = np.full(len(value), np.nan)
        if self.emitters is not None:
            reports = (own >= 0) & self.known[np.clip(own, 0, None)]
            emitters = Cohorts(self.emitters, self.shift[left], self.shift[right], np.where(reports, self.shift[np.clip(own, 0, None)], -1))
            enough = ~np.isnan(own_ghg) & (emitters.size >= MIN_PEERS)
            percentile = np.where(enough, emitters.percentile_rank(np.nan_to_num(own_ghg)), np.nan)
        return {
            "peer_count": cohort.size,
            "eui_percentile": cohort.percentile_rank(value),
            "ghg_percentile": percentile,
            "peer_q25_eui": cohort.quantile(0.25),
            "peer_median_eui": median,
            "peer_q75_eui": cohort.quantile(0.75),
            "eui_robust_z": z,
        }


class _Batch:
    """Peer groups from several sub-sequences of a pool, laid end to end and answered together."""

    def __init__(self) -> None:
        self.length, self.indices, self.parts = 0, [], []

    def add(self, peers: np.ndarray, targets: np.ndarray, left, right, own) -> None:
        """``peers`` indexes the pool; positions are relative to it."""
        self.parts.append((targets, left + self.length, right + self.length, np.where(own >= 0, own + self.length, -1)))
        self.indices.append(peers)
        self.length += len(peers)

    def take(self):
        parts = [np.concatenate(column) for column in zip(*self.parts)]
        return np.concatenate(self.indices), *parts


def cohort_batches(peers: pd.DataFrame, targets: pd.DataFrame, own: np.ndarray):
    """(stage per target, iterator over batches of targets that have a peer group)."""
    n, m = len(peers), len(targets)
    area, size = peers["floor_area_m2"].to_numpy(), targets["floor_area_m2"].to_numpy()
    hours, wanted = peers["weekly_hours"].to_numpy(), targets["weekly_hours"].to_numpy()

    def bounds(s: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = STAGES[s][1]
        if span is None:
            return np.zeros(len(some), dtype=np.int64), np.full(len(some), n, dtype=np.int64)
        return _area_bounds(area, size[some], *span)

    # the hours stage looks at the sub-sequence with compatible hours, once per distinct hours value
    by_hours = np.argsort(wanted, kind="stable")
    values, first = np.unique(wanted[by_hours], return_index=True)
    groups = {value: by_hours[start:stop] for value, start, stop in zip(values, first, [*first[1:], m]) if value > 0}

    def compatible(value: float, group: np.ndarray, fits: np.ndarray, shift: np.ndarray):
        left, right = bounds(0, group)
        mine = np.where(own[group] >= 0, shift[np.clip(own[group], 0, None)], -1)
        return shift[left], shift[right], mine

    def fitting(value: float) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore"):
            fits = np.abs(hours - value) / value <= HOURS_TOLERANCE
        return fits, np.concatenate([[0], np.cumsum(fits, dtype=np.int32)])

    def tiles(some: np.ndarray):
        return (some[at : at + BATCH_TARGETS] for at in range(0, len(some), BATCH_TARGETS))

    with_hours = np.zeros(m, dtype=np.int32)
    for value, group in groups.items():
        fits, shift = fitting(value)
        for some in tiles(group):
            left, right, mine = compatible(value, some, fits, shift)
            with_hours[some] = right - left - ((mine >= left) & (mine < right))
    stage = np.empty(m, dtype=np.int8)
    for some in tiles(np.arange(m)):
        counts = np.zeros((len(STAGES), len(some)), dtype=np.int64)
        counts[0] = with_hours[some]
        for s in range(1, len(STAGES)):
            left, right = bounds(s, some)
            counts[s] = right - left - ((own[some] >= left) & (own[some] < right))
        stage[some] = choose_stage(counts)
    del with_hours

    def batches():
        batch = _Batch()
        for value, group in groups.items():
            group = group[stage[group] == 0]
            if len(group):
                fits, shift = fitting(value)
                batch.add(np.flatnonzero(fits), group, *compatible(value, group, fits, shift))
            if batch.length > BATCH_PEERS:
                yield batch.take()
                batch = _Batch()
        if batch.parts:
            yield batch.take()
            batch = _Batch()
        later = np.flatnonzero(stage >= 1)
        if len(later):
            left, right = np.empty(len(later), dtype=np.int64), np.empty(len(later), dtype=np.int64)
            for s in range(1, len(STAGES)):
                here = np.flatnonzero(stage[later] == s)
                left[here], right[here] = bounds(s, later[here])
            batch.add(np.arange(n), later, left, right, own[later])
            yield batch.take()

    return stage, batches()


MEASURES = ["floor_area_m2", "weekly_hours", "eui", "ghg_intensity"]


def split_pool(batches: Iterator[pa.RecordBatch]) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, pa.Table]:
    """Measures of the peers in area order, measures of the targets, each target's own position among the peers (-1 if none), the targets' keys."""
    rows = pa.Table.from_batches([batch.select(["entity_key", "reporting_year", *MEASURES, "is_peer", "is_target"]) for batch in batches])
    order = pc.sort_indices(rows, [("floor_area_m2", "ascending"), ("entity_key", "ascending")]).to_numpy()
    is_peer, is_target = (rows[c].to_numpy()[order] for c in ("is_peer", "is_target"))
    own = np.where(is_peer, np.cumsum(is_peer, dtype=np.int64) - 1, -1)[is_target]
    keys = rows.select(["entity_key", "reporting_year"]).combine_chunks().take(order[is_target])
    peers, targets = {}, {}
    for c in MEASURES:
        values = rows[c].cast(pa.float64()).to_numpy()
        rows = rows.drop_columns([c])
        peers[c], targets[c] = values[order[is_peer]], values[order[is_target]]
    return pd.DataFrame(peers), pd.DataFrame(targets), own, keys


def _names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(", ")]


def _tiles(where: np.ndarray, *columns: np.ndarray, size: int = BATCH_TARGETS) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(where), size):
        yield tuple(column[at : at + size] for column in (where, *columns))


def benchmark_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage and statistics for every target of one pool of bounded size, some targets at a time."""
    peers, targets, own, keys = split_pool(batches)
    if not len(targets):  # nobody compares with this pool
        return
    stage, cohorts = cohort_batches(peers, targets, own)
    eui, ghg = peers["eui"].to_numpy(), peers["ghg_intensity"].to_numpy()
    value, own_ghg = targets["eui"].to_numpy(), targets["ghg_intensity"].to_numpy()
    columns = _names(RESULT_SCHEMA)

    def result(where: np.ndarray, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        named = keys.take(where).combine_chunks()
        arrays = [named[c].combine_chunks().cast(kind) for c, kind in zip(columns, (pa.string(), pa.int32()))]
        arrays += [pa.array(stage[where], pa.int32()), pa.array(found["peer_count"], pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(found[c], pa.float64(), from_pandas=True) for c in columns[4:])], columns)

    alone = np.flatnonzero(stage < 0)
    for (where,) in _tiles(alone):
        yield result(where, {"peer_count": np.zeros(len(where), dtype=np.int64)} | {c: np.full(len(where), np.nan) for c in columns[4:]})
    for at, *asked in cohorts:
        answers = _Answers(eui[at], ghg[at])
        for where, left, right, mine in _tiles(*asked):
            yield result(where, answers.statistics(value[where], own_ghg[where], left, right, mine))


HISTOGRAM_SCHEMA = "entity_key string, reporting_year int, bin int, `from` double, `to` double, count long, open_ended boolean"
HISTOGRAM_BINS = 18
CLIP = 0.99


def clipped_position(size: np.ndarray) -> np.ndarray:
    """Position of the histogram ceiling among the peers and the target, in ascending order."""
    return np.floor(CLIP * size).astype(np.int64)


def bin_thresholds(ceiling: np.ndarray) -> np.ndarray:
    """(targets, bins - 1): the smallest value that falls into bin 1, 2, ... by value / width."""
    width = ceiling[:, None] / HISTOGRAM_BINS
    number = np.arange(1, HISTOGRAM_BINS)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        edge = number * width
        for _ in range(3):
            down = np.nextafter(edge, -np.inf)
            edge = np.where(down / width >= number, down, edge)
        for _ in range(3):
            edge = np.where(edge / width < number, np.nextafter(edge, np.inf), edge)
    return edge


def histogram_rows(keys: pd.DataFrame, value, size, ceiling, top, below, upto) -> pd.DataFrame:
    """Bins of peers around each target.

    ``below`` counts the peers under each threshold and ``upto`` those up to the ceiling. The
    histogram covers the peers and the target; the target is then taken out of the closed bin, or
    the open bin, whose shown limits contain it.
    """
    m, bins = len(value), HISTOGRAM_BINS
    width = ceiling / bins
    cumulative = np.column_stack([np.zeros(m, dtype=np.int64), below, upto, size])
    counts = np.diff(cumulative, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(value > ceiling, bins, np.minimum(bins - 1, np.floor(np.nan_to_num(value / width)))).astype(np.int64)
    counts[np.arange(m), own] += 1
    overflow = counts[:, bins] > 0
    number = np.arange(bins + 1)[None, :]
    low = np.where(number == bins, ceiling[:, None], number * width[:, None])
    high = np.where(number == bins, top[:, None], (number + 1) * width[:, None])
    is_open = np.broadcast_to(number == bins, counts.shape)
    holds = (value[:, None] >= low) & ((value[:, None] < high) | is_open)
    flat = ceiling == 0  # everything is zero: one bin, limits 0 to 0
    shown = np.where(flat[:, None], number == 0, ~is_open | overflow[:, None])
    counts = np.where(flat[:, None], (size + 1)[:, None], counts - holds)
    at, index = np.nonzero(shown)
    return pd.DataFrame(
        {
            "entity_key": keys["entity_key"].to_numpy()[at],
            "reporting_year": keys["reporting_year"].to_numpy()[at],
            "bin": index,
            "from": low[at, index],
            "to": high[at, index],
            "count": counts[at, index],
            "open_ended": is_open[at, index] & ~flat[at],
        }
    )


def histogram_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histogram bins for every target of one pool of bounded size, some targets at a time."""
    peers, targets, own, keys = split_pool(batches)
    if not len(targets):
        return
    _, cohorts = cohort_batches(peers, targets, own)
    eui, value = peers["eui"].to_numpy(), targets["eui"].to_numpy()
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip(_names(HISTOGRAM_SCHEMA), kinds, strict=True)))
    for at, *asked in cohorts:
        ranks = RangeRanks(eui[at])
        for where, left, right, mine in _tiles(*asked, size=BATCH_TARGETS // HISTOGRAM_BINS):
            cohort, v = Cohorts(ranks, left, right, mine), value[where]
            position, (smaller, _) = clipped_position(cohort.size), cohort.counts(v)
            ceiling = np.where(position == smaller, v, cohort.value_at(position - (position > smaller)))
            top = np.maximum(v, cohort.value_at(cohort.size - 1))
            edges = bin_thresholds(ceiling)
            below = np.column_stack([cohort.counts(edges[:, j])[0] for j in range(edges.shape[1])])
            under, equal = cohort.counts(ceiling)
            bins = histogram_rows(keys.take(where).to_pandas(), v, cohort.size, ceiling, top, below, under + equal)
            yield pa.RecordBatch.from_pandas(bins, schema, preserve_index=False)


def pool_rows(entities: DataFrame, usable: Column) -> DataFrame:
    """Place entity-years into pools.

    A usable entity is a peer under its own level and under '*' (targets without a level compare
    with every level); it is a target in exactly one of them.
    """
    level = F.col("school_level")
    own = F.coalesce(level, F.lit("*"))
    places = F.array_compact(
        F.array(
            F.struct(own.alias("level_key"), F.lit(True).alias("is_target"), usable.alias("is_peer")),
            F.when(level.isNotNull() & usable, F.struct(F.lit("*").alias("level_key"), F.lit(False).alias("is_target"), usable.alias("is_peer"))),
        )
    )
    return (
        entities.filter(F.col("eui").isNotNull())
        .select(
            "entity_key", "reporting_year", "operation_category", "floor_area_m2", "weekly_hours", "eui", "ghg_intensity",
            F.explode(places).alias("_p"),
        )
        .select("*", "_p.*")
        .drop("_p")
    )


def _per_pool(entities: DataFrame, usable: Column, pool_limit: int, bounded_pool, schema: str, hot_pool) -> DataFrame:
    """Answer pools of a checked size in one task each and larger ones by ``hot_pool``."""
    rows = pool_rows(entities, usable)
    sizes = rows.groupBy(*POOL_KEYS).agg(F.count("*").alias("_n"), F.max("is_target").alias("_used"))
    oversized = sizes.filter(F.col("_n") > pool_limit)
    listed = oversized.collect()  # at most rows / limit
    bounded = rows.join(F.broadcast(oversized.select(*POOL_KEYS)), POOL_KEYS, "left_anti") if listed else rows
    result = spread(bounded, *POOL_KEYS).groupBy(*POOL_KEYS).applyInArrow(bounded_pool, schema)
    for year, category, level in [tuple(p)[:3] for p in listed if p["_used"]]:
        one = rows.filter((F.col("reporting_year") == year) & (F.col("operation_category") == category) & (F.col("level_key") == level))
        result = result.unionByName(hot_pool(one, min(pool_limit, SLICE_LIMIT)))
    return result


def peer_statistics(entities: DataFrame, usable: Column, pool_limit: int = POOL_LIMIT) -> DataFrame:
    """Chosen stage, peer count, quantiles, percentiles and robust z for every entity-year with an EUI."""
    from peerscope.operators.hot_pools import hot_pool_statistics

    return _per_pool(entities, usable, pool_limit, benchmark_pool, RESULT_SCHEMA, hot_pool_statistics)


def peer_histograms(entities: DataFrame, usable: Column, pool_limit: int = POOL_LIMIT) -> DataFrame:
    """EUI bins of each target's peers, the target itself taken out; none without a peer group."""
    from peerscope.operators.hot_pools import hot_pool_histograms

    return _per_pool(entities, usable, pool_limit, histogram_pool, HISTOGRAM_SCHEMA, hot_pool_histograms)


def stage_label(stage: Column) -> Column:
    label = F.lit(None).cast("string")
    for index, (text, _, _) in enumerate(STAGES):
        label = F.when(stage == index, text).otherwise(label)
    return label

"""Order statistics and cohorts against brute force, on small fixtures with hot groups."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.operators import bands, cohort, ranking
from peerscope.plans.benchmark import peer_metrics


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([1.0, 2.0, rng.random() * 9])) for _ in range(3000)]
    rows += [(None, float(v)) for v in range(7)] + [("nan", float("nan")), ("one", 4.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(8)


def test_exact_quantiles(skewed):
    rows, df = skewed
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["k"]: r for r in ranking.exact_quantiles(df, ["k"], F.col("v"), qs).collect()}
    groups = {}
    for k, v in rows:
        if v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["n"] == len(values)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, q), abs=1e-12), (k, name)


def test_group_percentile_ranks(skewed):
    rows, df = skewed
    groups = {}
    for k, v in rows:
        if v == v:
            groups.setdefault(k, []).append(v)
    for r in ranking.group_percentile_ranks(df, ["k"], F.col("v")).collect():
        values = np.array(groups[r["k"]])
        if len(values) == 1:
            assert r["percentile"] is None
            continue
        below, equal = (values < r["value"]).sum(), (values == r["value"]).sum() - 1
        assert r["percentile"] == pytest.approx((below + equal / 2) / (len(values) - 1) * 100)


def test_quantiles_of_one_global_group_and_a_hot_key(spark):
    rng = random.Random(31)
    rows = [("hot" if i % 100 else "rare", rng.choice([float(rng.randrange(40)), rng.gauss(0, 5)])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    qs = {"low": 0.013, "mid": 0.5, "top": 0.999}
    whole = ranking.exact_quantiles(df, [], F.col("v"), qs).first()
    values = [v for _, v in rows]
    assert whole["n"] == len(values) and [whole[name] for name in qs] == [pytest.approx(np.quantile(values, q)) for q in qs.values()]
    for r in ranking.exact_mad(df, ["k"], F.col("v")).collect():
        own = np.array([v for k, v in rows if k == r["k"]])
        away = np.abs(own - np.median(own))
        assert (r["median"], r["mad"], r["mean_ad"]) == (pytest.approx(np.median(own)), pytest.approx(np.median(away)), pytest.approx(away.mean()))
    floors = ranking.exact_quantiles(df.filter("v > 1e9"), ["k"], F.col("v"), qs).collect()
    assert floors == []


def test_deviations_read_their_input_once(spark, tmp_path):
    spark.range(500).selectExpr("id % 7 AS k", "cast(id * id % 101 AS double) AS v").write.parquet(str(tmp_path / "in"))
    plan = ranking.exact_mad(spark.read.parquet(str(tmp_path / "in")), ["k"], F.col("v"))._jdf.queryExecution().toString()
    assert str(tmp_path) not in plan  # what is left reads the stored counts


def test_histogram(spark):
    rng = random.Random(12)
    for bins, clip in ((24, 0.99), (7, 0.8)):
        values = [rng.expovariate(0.4) for _ in range(700)]
        rows = ranking.equal_width_bins(spark.createDataFrame([(v,) for v in values + [-3.0]], "v double"), [], F.col("v"), bins=bins, clip=clip).orderBy("bin").collect()
        top = sorted(values)[int(clip * (len(values) - 1))]
        want = [sum(1 for v in values if v <= top and min(bins - 1, int(v / (top / bins))) == b) for b in range(bins)] + [sum(v > top for v in values)]
        assert [r["count"] for r in rows] == want and [r["open_ended"] for r in rows] == [False] * bins + [True]
        assert rows[-1]["from"] == top and rows[-1]["to"] == max(values)


SCHEMA = "entity_key string, reporting_year int, operation_category string, school_level string, floor_area_m2 double, weekly_hours double, eui double, ghg_intensity double, ok boolean"


def random_entities(n, seed):
    rng = random.Random(seed)
    return [
        (
            f"s{i}", 2019, "school", rng.choice(["a", "a", None]), float(rng.choice([500, 1000, 1500, rng.random() * 3000 + 1])),
            rng.choice([40.0, 50.0, None, 62.5]), float(rng.choice([0.5, 0.5, rng.random()])), rng.choice([None, rng.random()]), rng.random() < 0.9,
        )
        for i in range(n)
    ]


def brute(rows, t):
    pool = [c for c in rows if c[8] and c[0] != t[0] and (t[3] is None or c[3] == t[3])]
    stages = []
    for _, span, hours in cohort.STAGES:
        if hours and not t[5]:
            continue
        fits = [c for c in pool if span is None or span[0] <= c[4] / t[4] <= span[1]]
        if hours:
            fits = [c for c in fits if c[5] is not None and abs(c[5] - t[5]) / t[5] <= 0.25]
        stages.append((cohort.STAGES.index((_, span, hours)), fits))
    for least in (20, 10):
        for stage, fits in stages:
            if len(fits) >= least:
                return stage, fits
    return -1, []


def test_cohorts_equal_brute_force(spark):
    rows = random_entities(150, 5)
    got = {r["entity_key"]: r for r in cohort.peer_statistics(spark.createDataFrame(rows, SCHEMA), F.col("ok")).collect()}
    for t in rows:
        stage, peers = brute(rows, t)
        r = got[t[0]]
        assert (r["peer_stage"], r["peer_count"]) == (stage, len(peers))
        if not peers:
            continue
        v = np.array([p[6] for p in peers])
        median, mad = np.quantile(v, 0.5), np.median(np.abs(v - np.quantile(v, 0.5)))
        assert r["peer_median_eui"] == pytest.approx(median) and r["peer_q75_eui"] == pytest.approx(np.quantile(v, 0.75))
        assert r["eui_percentile"] == pytest.approx(((v < t[6]).sum() + (v == t[6]).sum() / 2) / len(v) * 100)
        mean_ad = np.abs(v - median).mean()
        z = 0.6745 * (t[6] - median) / mad if mad > 0 else (t[6] - median) / (np.sqrt(np.pi / 2) * mean_ad) if mean_ad > 0 else 0.0
        assert r["eui_robust_z"] == pytest.approx(z)
        g = np.array([p[7] for p in peers if p[7] is not None])
        if t[7] is not None and len(g) >= 10:
            assert r["ghg_percentile"] == pytest.approx(((g < t[7]).sum() + (g == t[7]).sum() / 2) / len(g) * 100)
        else:
            assert r["ghg_percentile"] is None or r["ghg_percentile"] != r["ghg_percentile"]


def area_and_hours_counts(rows, t):
    pool = [c for c in rows if c[8] and c[0] != t[0] and (t[3] is None or c[3] == t[3])]
    for _, span, hours in cohort.STAGES:
        fits = [c for c in pool if span is None or span[0] <= c[4] / t[4] <= span[1]]
        if hours:
            known = t[5] is not None and t[5] > 0
            yield sum(c[5] is not None and abs(c[5] - t[5]) / t[5] <= 0.25 for c in fits) if known else None
        else:
            yield len(fits)


def test_stage_counts_equal_brute_force(spark):
    rows = [r[:5] + (random.Random(i).choice([r[5], r[5], 0.0, -3.0]),) + r[6:] for i, r in enumerate(random_entities(180, 6))]
    chosen = {r["entity_key"]: r for r in cohort.peer_statistics(spark.createDataFrame(rows, SCHEMA), F.col("ok")).collect()}
    found = bands.stage_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("ok")).collect()
    assert len(found) == len(rows)
    for t, r in zip(sorted(rows), sorted(found, key=lambda r: r["entity_key"]), strict=True):
        assert [r[c] for c in bands.COUNTS] == list(area_and_hours_counts(rows, t))
        if t[5] is None or t[5] > 0:
            assert (r["peer_stage"], r["peer_count"]) == (chosen[t[0]]["peer_stage"], chosen[t[0]]["peer_count"])
    assert bands.stage_counts(spark.createDataFrame([], SCHEMA), F.col("ok")).count() == 0


def test_one_large_pool_with_tied_areas_and_distinct_hours(spark):
    n = 10_000
    rng = np.random.default_rng(3)
    area, hours = rng.choice([500.0, 1000.0, 1500.0, 2000.0, 1234.5], n), rng.permutation(n) / 100 + 1  # 10,000 distinct hours
    rows = [(f"s{i:05}", 2019, "school", "a", float(a), float(h), 1.0, None, bool(i % 7)) for i, (a, h) in enumerate(zip(area, hours, strict=True))]
    found = sorted(bands.stage_counts(spark.createDataFrame(rows, SCHEMA), F.col("ok")).collect(), key=lambda r: r["entity_key"])
    usable = np.arange(n) % 7 > 0
    for i in range(0, n, 101):
        want = []
        for _, span, by_hours in cohort.STAGES:
            fits = usable & (np.arange(n) != i)
            if span:
                fits &= (area / area[i] >= span[0]) & (area / area[i] <= span[1])
            if by_hours:
                fits &= np.abs(hours - hours[i]) / hours[i] <= 0.25
            want.append(int(fits.sum()))
        assert [found[i][c] for c in bands.COUNTS] == want


def test_hot_pool_equals_bounded_pool(spark):
    rows = [r[:3] + ("a",) + r[4:] for r in random_entities(90, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    bounded = cohort.peer_statistics(df, F.col("ok")).toPandas().sort_values("entity_key").reset_index(drop=True)
    sliced = cohort.peer_statistics(df, F.col("ok"), pool_limit=45).toPandas().sort_values("entity_key").reset_index(drop=True)
    assert (bounded["peer_stage"] >= 0).all()
    import pandas as pd

    pd.testing.assert_frame_equal(bounded, sliced, check_dtype=False)
    order = ["entity_key", "bin"]
    whole = cohort.peer_histograms(df, F.col("ok")).toPandas().sort_values(order).reset_index(drop=True)
    parts = cohort.peer_histograms(df, F.col("ok"), pool_limit=45).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts, check_dtype=False)
    assert (whole["count"] >= 0).all()


def test_tasks_of_a_hot_pool_take_slices_smaller_than_a_pool(spark, monkeypatch):
    from peerscope.operators import hot_pools

    limits, make = [], hot_pools._Slices.__init__
    monkeypatch.setattr(hot_pools._Slices, "__init__", lambda self, peers, limit: limits.append(limit) or make(self, peers, limit))
    monkeypatch.setattr(cohort, "SLICE_LIMIT", 30)
    df = spark.createDataFrame([r[:3] + ("a",) + r[4:] for r in random_entities(90, 8)], SCHEMA)
    names = cohort._names(cohort.RESULT_SCHEMA)
    bounded = {r["entity_key"]: r for r in cohort.peer_statistics(df, F.col("ok")).select(names).collect()}
    assert not limits
    sliced = {r["entity_key"]: r for r in cohort.peer_statistics(df, F.col("ok"), pool_limit=80).select(names).collect()}
    assert limits == [30] and sliced.keys() == bounded.keys()
    for key, row in bounded.items():
        assert list(sliced[key]) == pytest.approx(list(row), nan_ok=True)


RECORD = (
    "facility_id long, school_id long, reporting_year int, operation_type string, school_level string, match_confidence double, "
    "total_site_energy_gj double, floor_area_m2 double, ghg_kg_co2e double, electricity_kwh double, weekly_hours double, quality_flags array<string>"
)


def records(seed=19):
    rng = random.Random(seed)
    out = []
    for school in range(1, 46):
        for year in (2014, 2015, 2016, 2019):
            area = rng.uniform(900, 4000)
            flags = ["negative_energy_value"] if school == 7 and year == 2019 else []
            out.append((1000 + school, school, year, "School", rng.choice(["elementary", "elementary", "secondary"]) if school % 9 else None, 1.0,
                        area * rng.uniform(0.2, 2.0), None if school == 5 else area, area * rng.uniform(5, 60), area * 80.0, 44.0, flags))
    return out


def test_benchmark_equals_brute_force(spark):
    rows = records()
    got = {(r["school_id"], r["reporting_year"]): r for r in peer_metrics(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {(r[1], r[2]) for r in rows}
    entities = [(f"s{r[1]}", r[2], "school", r[4], r[7], r[10], r[6] / r[7], r[8] / r[7], not r[11]) for r in rows if r[7]]
    for year in (2014, 2015, 2016, 2019):
        now = [e for e in entities if e[1] == year]
        for t in now:
            stage, peers = brute([e for e in now if e[8] or e[0] == t[0]], t)
            r = got[int(t[0][1:]), year]
            assert r["peer_count"] == len(peers)
            if len(peers) < 10:
                assert r["opportunity_score"] is None
                continue
            euis = np.array([p[6] for p in peers])
            assert r["eui_percentile"] == pytest.approx(100 * ((euis < t[6]).sum() + (euis == t[6]).sum() / 2) / len(peers))
            area = next(x[7] for x in rows if (x[1], x[2]) == (int(t[0][1:]), year))
            assert r["energy_gap_gj"] == pytest.approx(max(0, t[6] - np.median(euis)) * area)
            assert (r["opportunity_score"] is None) == (not t[8])
    assert all(got[5, y]["opportunity_score"] is None and got[5, y]["eui"] is None for y in (2014, 2019))
    assert got[3, 2019]["trend_years"] == [2014, 2015, 2016, 2019] and got[3, 2015]["trend_years"] == []


def test_entity_combination(spark):
    from peerscope.operators.entities import combine_entity_years

    rng = random.Random(23)
    rows = []
    for facility in range(1, 31):
        school = rng.choice([None, 1, 2, 3, 4, 5, 6])
        rows.append((facility, school, 2017, "School", "secondary", rng.choice([1.0, 0.9]), rng.choice([None, rng.uniform(10, 900)]), rng.choice([None, *[rng.uniform(100, 900)] * 4]), 1.0, 2.0, 40.0, []))
    got = {r["entity_key"]: r for r in combine_entity_years(spark.createDataFrame(rows, RECORD)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(f"f{r[0]}" if r[1] is None else f"s{r[1]}", []).append(r)
    assert set(got) == set(groups)
    for key, members in groups.items():
        r = got[key]
        assert r["facility_count"] == len(members) and r["match_confidence"] == min(m[5] for m in members)
        for column, at in (("total_site_energy_gj", 6), ("floor_area_m2", 7)):
            parts = [m[at] for m in members]
            assert r[column] == (None if None in parts else pytest.approx(sum(parts)))
        assert ("multiple_facilities_combined" in r["quality_flags"]) == (len(members) > 1)
        assert (r["school_id"] is None) == (members[0][1] is None)


def test_pages_of_an_index_are_those_of_the_list(spark):
    from peerscope.plans import reads

    draw = random.Random(3)
    rows = [(f"n{draw.randrange(50)}", f"s{i}", draw.choice([None, 1.0, 1.0, 2.0, draw.random()]), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, slug string, eui double, opportunity_score int, eui_percentile double, latest_year int").repartition(4)
    for descending in (False, True):
        index = reads.PageIndex(df, "eui", descending)
        whole = [r["slug"] for r in reads.in_order(df, "eui", descending).collect()]
        for number, size in ((1, 25), (4, 37), (12, 25), (13, 25), (1, 300), (2, 299)):
            assert [r["slug"] for r in index.page(number, size).collect()] == whole[(number - 1) * size : number * size]
    part = index.page(6, 25)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_part", part) and len(index.parts) > 1
    assert reads.PageIndex(df.filter("false")).page().collect() == []


def test_labels_are_converted_once(spark):
    from peerscope.functions import units
    from peerscope.operators.quantities import convert_quantities

    rows = [("1,000", "Square feet"), ("2", "m2"), ("3", "Mètres  Carrés"), ("4", "acres"), ("0", None), (None, "ft2"), ("x", None), ("5", None)]
    df = spark.createDataFrame(rows, "amount string, unit string")
    got = convert_quantities(df, F.col("amount"), F.col("unit"), units.AREA_TO_M2).collect()
    want = df.select("*", units.convert_quantity(F.col("amount"), F.col("unit"), units.AREA_TO_M2).alias("q")).select("amount", "unit", "q.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(rows)


def pool_batches(n, seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    columns = {
        "entity_key": [f"s{i:07}" for i in range(n)], "reporting_year": pa.array(np.full(n, 2019), pa.int32()), "floor_area_m2": rng.uniform(500, 5000, n).round(1),
        "weekly_hours": pa.array(rng.integers(28, 70, n).astype(float), mask=rng.random(n) < 0.2), "eui": rng.uniform(0.1, 3, n).round(3),
        "ghg_intensity": pa.array(rng.uniform(1, 60, n), mask=rng.random(n) < 0.3), "is_peer": rng.random(n) < 0.9, "is_target": rng.random(n) < 0.9,
    }
    return pa.table(columns).to_batches(max_chunksize=1000)


@pytest.mark.parametrize("answer", ["benchmark_pool", "histogram_pool"])
def test_memory_of_a_pool_does_not_grow_with_targets_times_columns(monkeypatch, answer):
    import tracemalloc

    import pandas as pd

    order = ["entity_key", *(["bin"] if answer == "histogram_pool" else [])]
    whole = pd.concat(b.to_pandas() for b in getattr(cohort, answer)(iter(pool_batches(600, 3)))).sort_values(order, ignore_index=True)
    monkeypatch.setattr(cohort, "BATCH_TARGETS", 90)
    tiles = pd.concat(b.to_pandas() for b in getattr(cohort, answer)(iter(pool_batches(600, 3)))).sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(whole, tiles)
    monkeypatch.setattr(cohort, "BATCH_TARGETS", 1 << 12)
    batches = pool_batches(60_000, 4)
    tracemalloc.start()
    for _ in getattr(cohort, answer)(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000 * 600  # 6,309 and 6,501 bytes a row when all targets were answered together

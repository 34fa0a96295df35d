"""Column expressions against plain Python rules, on random and edge inputs."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.functions import display as D
from peerscope.functions import stats as S
from peerscope.functions import text as X
from peerscope.functions import units as U
from peerscope.operators.entities import with_year_gaps, year_over_year
from peerscope.operators.score import data_confidence, opportunity_score
from peerscope.operators.trend import trend_per_entity


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def python_fold(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.split()).lower()


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("t")).alias("r")).collect())]


def test_fold_equals_unicode_rules(spark):
    draw = random.Random(11)
    blocks = [(0x20, 0x7F), (0xA0, 0x24F), (0x370, 0x3FF), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2100, 0x218F), (0x2460, 0x24FF), (0x3040, 0x30FF), (0xAC00, 0xAC80), (0xF900, 0xF940), (0xFB00, 0xFDFF), (0xFE20, 0xFE2F), (0xFF01, 0xFF9F)]
    texts = ["".join(chr(draw.randint(*draw.choice(blocks))) for _ in range(12)) for _ in range(300)]
    texts += ["ｶﾞｯｺｳ", "학교", "ﷺ", "", " \t ", "Wörld  ﬂag ¾"]
    texts = [t for t in texts if not re.search("[\x1c-\x1f\x85]", t)]
    for text, got in zip(texts, column(spark, texts, X.fold), strict=True):
        assert got == python_fold(text), text


def test_keys_are_stable_under_spelling(spark):
    names = ["Pine Ridge", "Lac Bleu", "Saint Odile"]
    long = [f"{n} Elementary School" for n in names] + [f"{n} Secondary School" for n in names]
    short = [f"{n} E.S." for n in names] + [f"{n} S.S." for n in names]
    for a, b in zip(column(spark, long, X.normalize_school_name), column(spark, short, X.normalize_school_name), strict=True):
        assert a == b == python_fold(a)
    for a, b in [("DSB of Ottertail", "Ottertail District School Board"), ("Kestrel CDSB", "Kestrel Catholic District School Board")]:
        assert len(set(column(spark, [a, b], X.board_key))) == 1
    shuffled = ["k7m 3P9", "K7M3P9", " k7m3p9 "]
    assert set(column(spark, shuffled, X.normalize_postal_code)) == {"K7M3P9"}
    assert column(spark, ["90210", "K7M", None], X.normalize_postal_code) == [None, None, None]
    assert column(spark, ["7 Heron Avenue North", "7 heron ave n"], X.normalize_address)[0] == column(spark, ["7 heron ave n"], X.normalize_address)[0]
    assert column(spark, ["\t two\n\nwords ", "\n", None], X.clean_text) == ["two words", None, None]


def test_years_and_periods(spark):
    draw = random.Random(5)
    texts = [f"{draw.choice(['file', 'x-', ''])}{draw.choice([1850, 2004, 2017, 20177, 2031])}{draw.choice(['', '.csv', ' 2004', '9'])}" for _ in range(80)]
    for text, got in zip(texts, column(spark, texts, X.year_in), strict=True):
        years = {int(y) for y in re.findall(r"(?<!\d)(20\d\d)(?!\d)", text)}
        assert got == (years.pop() if len(years) == 1 else None), text
    for month, year in [(6, 2016), (12, 2020), (2, 2019)]:
        day = {6: 30, 12: 31, 2: 28}[month]
        period = column(spark, [f"{year}-{month:02}-{day} 00:00:00"], X.reporting_period)[0]
        assert str(period["end"]) == f"{year}-{month:02}-{day}" and (period["end"] - period["start"]).days in (364, 365)
    assert column(spark, ["none"], X.reporting_period)[0]["end"] is None


def test_numbers_from_text(spark):
    draw = random.Random(8)
    values = [round(draw.uniform(-1e6, 1e6), draw.randint(0, 4)) for _ in range(60)]
    texts = [draw.choice(["{:,}", "${:,}", " {} ", "{}"]).format(v) for v in values]
    assert column(spark, texts, U.to_float) == [pytest.approx(v) for v in values]
    assert column(spark, ["seven", "8g", "inf", "nan", "-", "4e400", "", None], U.to_float) == [None] * 8


def test_units(one):
    draw = random.Random(2)
    for label, factor in [("Square feet", 0.3048**2), ("m2", 1.0), ("Pieds carrés", 0.3048**2)]:
        amount = draw.randint(1, 9999)
        assert one(U.convert_quantity(F.lit(str(amount)), F.lit(label), U.AREA_TO_M2))["value"] == pytest.approx(amount * factor)
    assert tuple(one(U.convert_quantity(F.lit("12"), F.lit("Furlongs"), U.AREA_TO_M2))) == (None, False)
    none = F.lit(None).cast("double")
    for amount in (33.0, 812.5):
        assert tuple(one(U.gas_quantities(none, F.lit(str(amount)), F.lit("GJ")))) == (None, amount, True)
        assert tuple(one(U.gas_quantities(none, F.lit(str(amount)), F.lit("m3")))) == (amount, None, True)
        assert tuple(one(U.gas_quantities(none, F.lit(str(amount)), F.lit("barrels")))) == (None, None, False)
    for total, area in [(77.0, 140.0), (0.0, 9.0)]:
        assert one(U.per_area(F.lit(total), F.lit(area))) == pytest.approx(total / area)
        assert one(U.per_area(F.lit(total), F.lit(0.0))) is None and one(U.per_area(F.lit(-total - 1), F.lit(area))) is None
    for own, middle, area in [(1.4, 0.9, 310.0), (0.2, 0.9, 310.0)]:
        assert one(U.gap_to_median(F.lit(own), F.lit(middle), F.lit(area))) == pytest.approx(max(0, own - middle) * area)
    assert tuple(one(U.coordinates(F.lit("48.25"), F.lit("-81.5")))) == (48.25, -81.5)
    assert one(U.coordinates(F.lit("-48.25"), F.lit("-81.5"))) is None and one(U.coordinates(F.lit("48.25"), F.lit("x"))) is None
    for pct in (-40, -7.5, -1, 3, 9.9, 60):
        assert one(U.trend_factor(F.lit(float(pct)))) == pytest.approx(min(1, max(0, (pct + 10) / 20)))
    assert one(U.reported_sum([none, F.lit(1.5), F.lit(4.0), none])) == 5.5 and one(U.reported_sum([none])) is None


def test_plausibility(one):
    area = 2400.0

    def flags(**change):
        values = {f: None for f in U.ENERGY_FIELDS} | {"floor_area_m2": area, "total_site_energy_gj": 0.9 * area, "ghg_kg_co2e": 20 * area} | change
        return set(one(U.quality_flags(lambda f: F.lit(values[f]).cast("double"), F.lit(2018))))

    low, high = U.EUI_PLAUSIBLE
    for eui in (low / 2, low * 1.01, high * 0.99, high * 2):
        assert ("implausible_intensity" in flags(total_site_energy_gj=eui * area)) == (not low <= eui <= high)
    for ghg in (U.GHG_PLAUSIBLE_MAX * 0.9, U.GHG_PLAUSIBLE_MAX * 1.1):
        assert ("implausible_intensity" in flags(ghg_kg_co2e=ghg * area)) == (ghg > U.GHG_PLAUSIBLE_MAX)
    assert "missing_floor_area" in flags(floor_area_m2=None) and "negative_energy_value" in flags(fuel_oil_gj=-2.0)


def test_statistics(one):
    draw = random.Random(21)
    for n in (1, 2, 7, 40):
        values = sorted(draw.choice([2.5, draw.uniform(0, 9)]) for _ in range(n))
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert one(S.quantile(arr(values), q)) == pytest.approx(np.quantile(values, q))
        x = draw.choice(values)
        below, equal = sum(v < x for v in values), sum(v == x for v in values)
        assert one(S.percentile_rank(F.lit(x), arr(values))) == pytest.approx(100 * (below + equal / 2) / n)
        center = np.median(values)
        mad, mean = np.median(np.abs(values - center)), np.mean(np.abs(values - center))
        want = 0.6745 * (3.1 - center) / mad if mad else (3.1 - center) / (math.sqrt(math.pi / 2) * mean) if mean else None
        got = one(S.robust_z_of(F.lit(3.1), arr(values)))
        assert got is None if want is None else got == pytest.approx(want)
    assert one(S.quantile(arr([]), 0.5)) is None and one(S.quantile(arr([3]), -0.1)) is None
    points = [(x, draw.uniform(-3, 3)) for x in (2001, 2004, 2005, 2011)]
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(y).alias("y")) for x, y in points])
    assert one(S.linear_slope(line)) == pytest.approx(np.polyfit(*zip(*points, strict=True), 1)[0])
    assert one(S.linear_slope(F.slice(line, 1, 1))) is None
    assert [one(S.anomaly_label(F.lit(z))) for z in (1.99, 2.0, 3.49, 3.51)] == ["typical", "elevated", "elevated", "unusually_high"]


def test_display(one):
    for value in (5321.0, 73.46, 0.0):
        number = f"{value:,.1f}" if value < 100 else f"{value:,.0f}"
        assert one(D.gj(F.lit(value))) == f"{number} GJ"
        assert one(D.tonnes_co2e(F.lit(value * 1000))) == f"{number} t CO₂e"
        assert one(D.eui(F.lit(value))) == f"{value:,.2f} GJ/m²" and one(D.ghg_intensity(F.lit(value))) == f"{value:,.1f} kg CO₂e/m²"
        assert one(D.kwh(F.lit(value))) == f"{value:,.0f} kWh" and one(D.area(F.lit(value))) == f"{value:,.0f} m²"
        assert one(D.kwh_per_m2(F.lit(value))) == f"{value:,.0f} kWh/m²" and one(D.ekwh_per_m2(F.lit(value))) == f"{value:,.0f} ekWh/m²"
        assert tuple(one(D.split_unit(D.gj(F.lit(value))))) == (number, "GJ")
    for value in (6.54, -12.3, 0.04):
        sign = "+" if round(value, 1) > 0 else "−" if round(value, 1) < 0 else ""
        assert one(D.signed_percent(F.lit(value))) == f"{sign}{abs(round(value, 1))}%"
    for n in (5, 23, 31, 42, 112, 113, 1001):
        ending = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
        assert one(D.ordinal(F.lit(float(n)))) == f"{n}{ending}"
    assert one(D.percentile(F.lit(63.0))) == "63rd percentile"
    for bad in (None, float("nan"), float("inf")):
        assert one(D.kwh(F.lit(bad).cast("double"))) == "—"
    assert one(D.year_range(F.array(F.lit(2014), F.lit(2009)))) == "2009–2014" and one(D.year_range(F.array(F.lit(2014)))) == "2014"


def test_trend(spark):
    draw = random.Random(6)
    for years in ([2012, 2013, 2016], [2010, 2011, 2012, 2013, 2014, 2015, 2016], [2018, 2019, 2020, 2021, 2022, 2023], [2020, 2021, 2023]):
        series = [(y, draw.uniform(0.3, 2)) for y in years]
        kept = [p for p in series if p[0] not in (2020, 2021)][-5:]
        row = trend_per_entity(spark.createDataFrame([("k", y, v) for y, v in series], "k string, year int, value double"), "k").first()
        if len(kept) < 3:
            assert row["trend_pct"] is None and row["trend_years"] == []
            continue
        assert row["trend_years"] == [y for y, _ in kept]
        slope = np.polyfit(*zip(*kept, strict=True), 1)[0]
        assert row["trend_pct"] == pytest.approx(100 * slope / np.mean([v for _, v in kept]))


def test_year_over_year_and_gaps(spark):
    draw = random.Random(7)
    series = [(k, y, draw.uniform(0.5, 2)) for k in "pqr" for y in sorted(draw.sample(range(2005, 2019), 8))]
    rows = spark.createDataFrame(series, "k string, year int, value double")
    value = {(k, y): v for k, y, v in series}
    want = {(k, y): 100 * (v / value[k, y - 1] - 1) for (k, y), v in value.items() if (k, y - 1) in value}
    got = year_over_year(rows, "k").collect()
    assert {(r["k"], r["year"]) for r in got} == set(want)
    for r in got:
        assert r["change_pct"] == pytest.approx(want[r["k"], r["year"]]) and r["large"] == (abs(r["change_pct"]) > 30)
    for r in with_year_gaps(rows, "k").collect():
        assert r["missing"] == ((r["k"], r["year"]) not in value)


def test_opportunity_score(one):
    for percentile, peers, pct, match, flags in [
        (31.0, 45, 4.0, 0.97, []), (88.5, 14, None, 0.8, []), (50.0, 20, -30.0, None, ["missing_floor_area"]),
        (64.0, 3, 1.0, 1.0, []), (None, 40, 1.0, 1.0, []), (64.0, 40, 1.0, 1.0, ["implausible_intensity"]),
    ]:
        got = one(opportunity_score(
            F.lit(percentile).cast("double"), F.lit(peers), F.lit(pct).cast("double"), F.array(*map(F.lit, range(2014, 2018))),
            F.lit(match).cast("double"), F.array(*map(F.lit, flags)).cast("array<string>"),
        ))
        if percentile is None or peers < 10 or "implausible_intensity" in flags:
            assert got["suppressed"] and got["score"] is None and len(got["reasons"]) == 1
            continue
        share = percentile / 100
        raw = share if pct is None else 0.8 * share + 0.2 * min(1, max(0, (pct + 10) / 20))
        points = 1 + (peers >= 20) + 2 * (pct is not None) + ((match or 0) >= 0.95) - bool(flags)
        level = "High" if points >= 5 else "Medium" if points >= 3 else "Low"
        assert (got["score"], got["confidence"], got["used_trend"]) == (math.floor(100 * raw + 0.5), level, pct is not None)


def test_data_confidence(one):
    def rated(match=0.99, area=810.0, peers=33, years=6, located=True, large=False, flags=()):
        latest = F.struct(
            F.lit(area).cast("double").alias("floor_area_m2"), F.lit(700.0).alias("total_site_energy_gj"), F.lit(1).alias("facility_count"),
            F.lit(False).alias("total_derived"), F.array(*map(F.lit, flags)).cast("array<string>").alias("quality_flags"),
        )
        got = one(data_confidence(F.lit(match).cast("double"), F.array(F.lit("address_board")), latest, F.lit(years), F.lit(peers), F.lit(located), F.lit(large)))
        return got["level"], sorted(r["severity"] for r in got["reasons"])

    assert rated() == ("High", [])
    assert rated(located=False) == ("High", ["info"])
    assert rated(years=2, large=True) == ("Medium", ["caution", "caution"])
    assert rated(match=0.5, peers=12) == ("Medium", ["caution", "caution"])
    assert rated(match=None, peers=9) == ("Low", ["limiting", "limiting"])
    assert rated(area=None, flags=["negative_energy_value", "unrecognized_unit:gas"]) == ("Low", ["limiting"] * 3)

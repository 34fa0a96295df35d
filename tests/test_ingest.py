"""Generated files in three layouts through reading, linkage, tables and benchmark; expectations follow from the generator."""

import csv
import difflib
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerscope.operators import linkage as L
from peerscope.operators import lookup as S
from peerscope.plans import ingest as I
from peerscope.sources import files, grids, sinks

DRAW = random.Random(77)
BIRDS = ["Heron", "Osprey", "Kestrel", "Plover", "Grebe", "Avocet", "Dunlin", "Whimbrel"]
TOWNS = ["Quill Bay", "Fernhollow"]
BOARDS = [("Q7", "Quill District School Board"), ("F3", "Conseil scolaire Fougère")]
FEET = 0.3048**2


def directory():
    """(number, name, town, street, board) of schools; the first two share name and town, the last repeats a number."""
    rows = [(str(500 + i), f"{bird} Public School", TOWNS[i % 2], f"{10 + i} {bird} Road", BOARDS[i % 2]) for i, bird in enumerate(BIRDS)]
    twin = ("590", rows[0][1], rows[0][2], "77 Twin Road", rows[0][4])
    repeated = (rows[3][0], "Another Name", TOWNS[1], "1 Other Road", BOARDS[1])
    return [rows[0], twin, *rows[1:], repeated]


SCHOOLS = directory()


def reports():
    """Rows of the middle layout, each with the outcome it must have."""
    out = []
    for number, name, town, street, (_, board) in SCHOOLS[2:-1]:
        square = DRAW.random() < 0.5
        out.append(
            {
                "kind": "address" if number == "505" else "name", "number": number, "board": board, "town": town, "street": street,
                "name": "Marsh Campus" if number == "505" else name, "area": DRAW.randint(2000, 9000), "unit": "Square feet" if square else "Square meters",
                "kwh": DRAW.randint(1000, 90_000), "gas": DRAW.randint(1, 900), "gas_unit": DRAW.choice(["Cubic Meter", "Giga Joule"]), "intensity": round(DRAW.uniform(0.3, 1.5), 2),
            }
        )
    base = out[0]
    out.append(base | {"kind": "ambiguous", "number": None, "name": SCHOOLS[0][1], "town": SCHOOLS[0][2], "board": SCHOOLS[0][4][1], "street": ""})
    out.append(base | {"kind": "unmatched", "number": None, "name": "Zzyx Workshop", "street": "", "kwh": -8, "intensity": None})
    out.append(base | {"kind": "unmatched", "number": None, "name": "Bright Annex", "street": "", "unit": "Furlongs"})
    return out


REPORTS = reports()
HEAD_B = (
    "Year,Sector,SubSector,Organization,Operation,Operation Type,Address,City,Postal Code,Total Indoor Space_x,Unit of Measure,Weekly Average Hours,Number of Portables,"
    "Electricity_Quantity,Electricity_Unit,NaturalGas_Quantity,NaturalGas_Unit,GHG Emissions KG,Energy Intensity GJ_m2"
).split(",")


def write(path, lines, encoding="utf-8"):
    with path.open("w", encoding=encoding, newline="") as f:
        csv.writer(f).writerows(lines)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    head = "Board Number,Board Name,Board Type,Board Language,School Number,School Name,School Level,School Language,School Type,Street,City,Province,Postal Code,Grade Range,Website,Board Website"
    rows = [[b, name_b, "Public", "English", n, name, "Elementary", "English", "Public", street, town, "ON", "k1a 0b1", "K-8", "", ""] for n, name, town, street, (b, name_b) in SCHOOLS]
    write(root / "schools.csv", [["List of places"], head.split(","), *rows])
    lines = [
        ["2018", "School Board", "School Board", r["board"], r["name"], "School", r["street"], r["town"], "", f"{r['area']:,}", r["unit"], "44", "1", f"{r['kwh']:,}", "kWh", str(r["gas"]), r["gas_unit"], "", r["intensity"] or ""]
        for r in REPORTS
    ]
    hospital = ["2018", "Hospital", "Hospital", "Town Clinic", "Clinic", "Clinic", *[""] * 13]
    write(root / "energy-2018.csv", [HEAD_B, *lines, [""] * len(HEAD_B), lines[0], hospital], "utf-8-sig")
    head_c = (
        "Year,Sector,Organization,Property Name,Primary Property Type - Self Selected,Portfolio Manager Property ID,Year Ending,Address,City,Property GFA - Self-Reported (m²),"
        "Custom Property ID 1 - Name,Custom Property ID 1 - Value,Electricity Use - Grid Purchase (kWh),Natural Gas Use (GJ),Fuel Oil #2 Use (GJ),Site Energy Use (GJ),Total (Location-Based) GHG Emissions (Metric Tons CO2e)"
    )
    r = REPORTS[0]
    write(root / "energy-2023.csv", [head_c.split(","), ["2023", "School Boards", r["board"], r["name"], "K-12 School", "9", "2024-06-30 00:00:00", r["street"], r["town"], "3100.5", "Weekly Average Hours", "41", "71000", "Not Available", "18", "2750", "31.5"]])
    head_a = "Sector Name,Organization Name,Operation Name,City,Total Floor Area,Unit1,Electricity,Unit2,Énergie"
    write(root / "energy-2013.csv", [["Rapport"], ["année"], head_a.split(","), ["School Boards", r["board"], r["name"], r["town"], "1,250.5", "Mètres carrés", "9", "kWh", "é"], ["School Boards", r["board"], "", r["town"], "5", "m2", "1", "kWh", "é"]], "cp1252")
    return root


@pytest.fixture(scope="module")
def run(spark, folder):
    return I.ingest(spark, str(folder / "schools.csv"), [str(folder / "energy-2018.csv"), str(folder / "energy-2023.csv")])


def kinds(*wanted):
    return sum(r["kind"] in wanted for r in REPORTS)


def test_summary(run):
    counts = {(r["section"], r["label"]): r["n"] for r in run.summary.collect()}
    total = {label: n for (section, label), n in counts.items() if section == "total"}
    rows = len(REPORTS) + 1 + 1  # the repeated row and the other file's
    assert (total["rows read"], total["rows in sector"], total["accepted"], total["rejected"]) == (rows + 1, rows, rows - 1, 1)
    assert (total["schools"], total["boards"], total["directory rejected"]) == (len(SCHOOLS) - 1, len(BOARDS), 1)
    assert {label for section, label in counts if section == "year"} == {"2018", "2023"}
    methods = {label: n for (s, label), n in counts.items() if s == "method"}
    assert methods == {"exact_name_board": kinds("name"), "address_board": kinds("address")}
    assert counts[("status", "ambiguous")] == kinds("ambiguous") and counts[("status", "unmatched")] == kinds("unmatched")
    flags = {label: n for (s, label), n in counts.items() if s == "flag"}
    assert flags["negative_energy_value"] == sum(r["kwh"] < 0 for r in REPORTS) and flags["unrecognized_unit:floor_area"] == 1
    assert flags["duplicate_facility_year"] == 1
    assert flags["total_energy_derived_from_reported_intensity"] == sum(r["intensity"] is not None and r["unit"] != "Furlongs" for r in REPORTS)


def test_measures(run):
    rows = {(r["facility_name"], r["reporting_year"]): r for r in run.energy_records.collect()}
    for r in REPORTS:
        got = rows[r["name"], 2018]
        area = r["area"] * (FEET if r["unit"] == "Square feet" else 1) if r["unit"] != "Furlongs" else None
        assert got["floor_area_m2"] == (None if area is None else pytest.approx(area))
        assert got["electricity_gj"] == pytest.approx(r["kwh"] * 0.0036)
        assert (got["natural_gas_m3"], got["natural_gas_gj"]) == ((r["gas"], None) if r["gas_unit"] == "Cubic Meter" else (None, r["gas"]))
        assert got["total_site_energy_gj"] == (pytest.approx(area * r["intensity"]) if area and r["intensity"] else None)
    new = rows[REPORTS[0]["name"], 2023]
    assert (new["floor_area_m2"], new["weekly_hours"], new["total_site_energy_gj"], new["fuel_oil_gj"], new["natural_gas_gj"]) == (3100.5, 41, 2750, 18, None)
    assert new["ghg_kg_co2e"] == pytest.approx(31_500) and (str(new["reporting_period_start"]), str(new["reporting_period_end"])) == ("2023-07-01", "2024-06-30")
    assert new["source_key"] == rows[REPORTS[0]["name"], 2018]["source_key"]
    rejected = {(r["source"], r["reject_reason"]) for r in run.rejected.collect()}
    assert rejected == {("energy-2018.csv", "duplicate_facility_year"), ("schools.csv", "duplicate_school_number")}


def test_tables_are_idempotent_and_linked(spark, run, tmp_path):
    tables = I.relational_tables(run)
    slugs = [r["slug"] for r in tables["schools"].collect()]
    assert len(set(slugs)) == len(slugs) == len(SCHOOLS) - 1
    numbers = {r["facility_name"]: r["school_number"] for r in tables["facilities"].collect()}
    assert numbers == {r["name"]: r["number"] for r in REPORTS}
    energy = tables["energy_records"]
    energy.write.parquet(str(tmp_path / "v1"))
    again = sinks.upsert(spark, str(tmp_path / "v1"), energy, ["facility_key", "reporting_year"], str(tmp_path / "v2"))
    assert again.count() == energy.count() == len(REPORTS) + 1
    with pytest.raises(ValueError, match="Duplicate"):
        sinks.upsert(spark, str(tmp_path / "v1"), energy.union(energy), ["facility_key", "reporting_year"], str(tmp_path / "v3"))
    review = I.review_list(run.facilities)
    assert {r["facility_name"]: r["status"] for r in review.collect()} == {r["name"]: r["kind"] for r in REPORTS if r["number"] is None}
    listed = I.review_candidates(review, run.candidates).collect()
    assert {r["school_number"] for r in listed} == {SCHOOLS[0][0], SCHOOLS[1][0]}
    assert I.facility_year_input(tables).filter("school_id is not null").count() == kinds("name", "address") + 1


def test_old_layout_and_encoding(spark, folder):
    raw = grids.read_records(spark, [str(folder / "energy-2013.csv")], I.C.ENERGY_ALIASES, I.C.ENERGY_REQUIRED)
    assert [r["raw"]["Énergie"] for r in raw.collect()] == ["é", "é"]
    organizations = spark.createDataFrame([(BOARDS[0][1], BOARDS[0][0])], "organization_name string, board_number string")
    _, entries, rejected = I.prepare_energy(raw, organizations)
    assert (entries.first()["reporting_year"], entries.first()["floor_area_m2"]) == (2013, 1250.5)
    assert rejected.first()["reject_reason"] == "missing_organization_or_facility_name"
    with pytest.raises(ValueError, match="required column"):
        grids.read_records(spark, [str(folder / "schools.csv")], I.C.ENERGY_ALIASES, I.C.ENERGY_REQUIRED)


def test_grids_lose_no_cell(spark, tmp_path):
    rows = [["a\nb", "", 'say "hi"', *[""] * 4, "", *[str(i) for i in range(12)], "z\n,z"], ["x"], ["", ""], ["é", "", "last", ""], [f"c{i}" for i in range(300)]]
    write(tmp_path / "wide.csv", rows)
    write(tmp_path / "old.csv", [["naïve – “q”", "é,é"]], "cp1252")
    got = {}
    for r in grids.read_grids(spark, [str(tmp_path / "wide.csv"), str(tmp_path / "old.csv")]).orderBy("row_no").collect():
        got.setdefault(r["source"], []).append([c or "" for c in r["cells"]])
    want = [[*row[: max(i for i, c in enumerate(row) if c) + 1]] for row in rows if any(row)]
    assert got == {"wide.csv": want, "old.csv": [["naïve – “q”", "é,é"]]}


def test_overrides_and_decisions(spark, run):
    name = next(r["name"] for r in REPORTS if r["kind"] == "ambiguous")
    key, chosen, schools = run.facilities.filter(F.col("facility_name") == name).first()["facility_key"], SCHOOLS[1][0], run.schools
    decided = spark.createDataFrame([(key, "match", chosen, "seen")], "facility_key string, decision string, school_number string, note string")
    bare = run.facilities.drop("match_status", "match_method", "match_confidence", "school_number", "candidate_group", "candidate_count")
    row = L.match_facilities(bare, schools, decided)[0].filter(F.col("facility_key") == key).first()
    assert (row["match_status"], row["match_method"], row["school_number"]) == ("matched", "override", chosen)
    with pytest.raises(ValueError, match="unknown school"):
        L.check_overrides(decided.withColumn("school_number", F.lit("0")), schools)
    review = I.review_list(run.facilities)
    new = spark.createDataFrame([(key[:16], "no_match", None, "desk", 4)], "prefix string, decision string, school_number string, note string, line int")
    assert [(r["facility_key"], r["decision"]) for r in I.apply_decisions(decided, new, review, schools).collect()] == [(key, "no_match")]
    with pytest.raises(ValueError, match="exactly one"):
        I.apply_decisions(decided, new.withColumn("prefix", F.lit("@")), review, schools)


def test_similar_pairs_equal_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = ["maple", "north", "school", "st", "river", "public", "oak", "a", "lakeside"]

    def name():
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        at = rng.randrange(len(text))
        return (text[:at] + text[at + 1 :]).strip() or "x"

    left = [("b1" if rng.random() < 0.8 else "b2", name()) for _ in range(80)]
    right = [("b1" if rng.random() < 0.8 else "b2", name()) for _ in range(80)]

    def key(text):
        return " ".join(sorted(text.split()))

    for threshold in (0.75, 0.85):
        want = {
            (b, x, y): SequenceMatcher(None, key(x), key(y)).ratio()
            for b, x in set(left) for c, y in set(right) if b == c and SequenceMatcher(None, key(x), key(y)).ratio() >= threshold
        }
        got = L.similar_name_pairs(spark.createDataFrame(left, "block string, name string"), spark.createDataFrame(right, "block string, name string"), threshold)
        assert {(r["block"], r["left_name"], r["right_name"]): r["score"] for r in got.collect()} == want


def test_lookup(spark):
    places = [(f"{bird} {kind} School", f"{bird}-{kind}".lower(), TOWNS[i % 2], BOARDS[i % 2][1]) for i, (bird, kind) in enumerate((b, k) for b in BIRDS for k in ("Public", "Secondary"))]
    schools = spark.createDataFrame(places, "name string, slug string, city string, board_name string")
    boards = spark.createDataFrame([(name, number.lower()) for number, name in BOARDS], "name string, slug string")
    asked = [b.lower() for b in BIRDS] + [b[:4].upper() for b in BIRDS] + [b[:3] + b[4:] for b in BIRDS if len(b) > 5] + [TOWNS[0], "fougere", "q", "0000"]
    rows = S.lookup(spark.createDataFrame([(q,) for q in asked], "text string"), S.search_documents(schools, boards)).collect()
    first = {(r["query"], r["kind"]): r for r in rows if r["position"] == 1}

    def top(query, kind="school"):
        return first.get((query if (query, kind) in first else query.lower(), kind))

    for bird in BIRDS:
        assert top(bird.lower())["label"].startswith(bird) and top(bird[:4].upper())["label"].startswith(bird)
        if len(bird) > 5:
            assert top(bird[:3] + bird[4:])["label"].startswith(bird)
    assert top(TOWNS[0], "city")["sublabel"] == f"{sum(p[2] == TOWNS[0] for p in places)} schools"
    assert top("fougere", "board")["label"] == BOARDS[1][1]
    assert top("q") is None and top("0000") is None


def test_file_rules_and_hashes(spark, folder):
    listed = files.list_files(spark, str(folder / "*.csv"))
    assert listed.count() == len(list(folder.glob("*.csv"))) == 4
    assert files.newest_per_folder(listed).count() == 1
    hashes = files.file_hashes(spark, [str(folder / "schools.csv")])
    assert hashes.first()["sha256"] == hashlib.sha256((folder / "schools.csv").read_bytes()).hexdigest()
    assert len(files.source_hash(hashes).first()["source_hash"]) == 64


def test_ratios_equal_the_definition():
    draw = random.Random(77)
    word = lambda letters, n: "".join(draw.choices(letters, k=n))
    left = [word("abcde ", draw.randint(0, 30)) for _ in range(1500)] + ["", "a", "x" * 250, word("abc", 220), "é中😀 b", word("ab", 900)]
    right = [a[:5] + word("abcde ", 3) + a[8:] if i % 2 else word("abcde ", draw.randint(0, 30)) for i, a in enumerate(left[:1500])] + ["", "", "x" * 230, word("abc", 205), "😀中é b", word("ab", 150)]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)]
    assert L.ratios(pd.Series(left), pd.Series(right)).tolist() == want
    assert L.ratios(pd.Series(left), pd.Series(right), 0.75).tolist() == [x if x >= 0.75 else 0 for x in want]


@pytest.mark.parametrize("block, ending", [(300, "\n"), (1 << 27, "\r\n")])
def test_records_run_over_blocks_of_a_file(spark, tmp_path, block, ending):
    draw = random.Random(5)
    cell = lambda: "".join(draw.choices(['"', ",", "\n", "a", "bc", "é", " ", '""', 'x,"y'], k=draw.choice([0, 1, 2, 9])))
    tables = {}
    for name in ("one.csv", "two.csv"):
        rows = [[cell() for _ in range(draw.randint(1, 4))] for _ in range(400)] + [["one", "z" * 2000 + "\n" + "q" * 900, ""]] + [[cell(), "end"] for _ in range(30)]
        with open(tmp_path / name, "w", newline="") as out:
            csv.writer(out, lineterminator=ending).writerows(rows)
        kept = []
        for row in rows:
            while row and not row[-1]:
                row = row[:-1]
            kept += [[c or None for c in row]] if row else []
        tables[name] = list(enumerate(kept))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        lines = grids._lines(spark, [f"{tmp_path}/*.csv"])
        assert lines.select("path", "block").distinct().count() > (50 if block == 300 else 0)
        found = grids.read_grids(spark, [f"{tmp_path}/*.csv"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, want in tables.items():
        assert sorted((r["row_no"], r["cells"]) for r in found if r["source"] == name) == want


def test_a_failed_replace_leaves_the_old_table(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 3 AS part")
    sinks.replace_table(rows, "held_table", f"{tmp_path}/held", ["part"])
    broken = rows.selectExpr("id + 1000 AS id", "CASE WHEN id = 99 THEN raise_error('lost') ELSE part END AS part")
    with pytest.raises(Exception, match="lost"):
        sinks.replace_table(broken, "held_table", f"{tmp_path}/held", ["part"])
    assert {r["id"] for r in spark.table("held_table").collect()} == set(range(100))
    sinks.replace_table(rows.filter("id < 5"), "held_table", f"{tmp_path}/held")
    assert {(r["id"], r["part"]) for r in spark.table("held_table").collect()} == {(i, i % 3) for i in range(5)}
    spark.sql("DROP VIEW held_table")


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    spark.range(40).selectExpr("id", "id % 4 AS year", "'old' AS v").write.partitionBy("year").parquet(path)
    stored = lambda: {f.name for f in (tmp_path / "table").rglob("*.parquet")}
    before = stored()
    payload = spark.createDataFrame([(2, 2, "new"), (100, 2, "new"), (3, 9, "moved")] + [(i, 9, "moved") for i in range(7, 40, 4)], "id long, year int, v string")
    found = sinks.upsert_partitions(spark, path, payload, ["id"], ["year"]).collect()
    want = {i: (i % 4, "old") for i in range(40)} | {i: (9, "moved") for i in range(3, 40, 4)} | {2: (2, "new"), 100: (2, "new")}
    assert {r["id"]: (r["year"], r["v"]) for r in found} == want and len(found) == len(want)
    assert not (tmp_path / "table" / "year=3").exists()  # all of its rows moved
    untouched = {f.name for y in (0, 1) for f in (tmp_path / "table" / f"year={y}").glob("*.parquet")}
    assert untouched <= before and len(stored() & before) == len(untouched)
    with pytest.raises(ValueError):
        sinks.upsert_partitions(spark, path, payload.union(payload), ["id"], ["year"])


def test_large_files_are_hashed_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BUFFER", 1000)
    bodies = {"tiny": b"\n", "small one, 100 %": b"x" * 999, "large": random.Random(2).randbytes(300_001)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = {r["file"]: r["sha256"] for r in files.file_hashes(spark, [str(tmp_path)]).collect()}
    assert found == {k: hashlib.sha256(v).hexdigest() for k, v in bodies.items()}


@pytest.mark.parametrize("tile", [40, 10_000])
def test_couples_of_random_letters_are_ruled_out_before_they_are_rows(spark, tile):
    draw = random.Random(9)
    word = lambda n: "".join(draw.choices("abcdefgh", k=n))
    left = [f"{word(7)} {word(6)}" for _ in range(120)] + ["a", "é中 😀b", word(70), word(230), "  "]
    right = [x[:4] + x[5:] if i % 3 else x[8:] + " " + x[:7] for i, x in enumerate(left[:60])] + [f"{word(6)} {word(7)}" for _ in range(60)] + ["a", "é中 😀c", left[122][3:], left[123][5:], ""]
    key = lambda x: " ".join(sorted(x.split()))
    ratio = lambda x, y: difflib.SequenceMatcher(None, key(x), key(y)).ratio()
    frames = [spark.createDataFrame([(b, x) for b in ("one", "two") for x in side] + [(None, "a")], "block string, name string") for side in (left, right)]
    for threshold in (0.5, 0.75, 0.85):
        want = {(x, y): ratio(x, y) for x in set(left) for y in set(right) if key(x) and key(y) and ratio(x, y) >= threshold}
        got = L.similar_name_pairs(*frames, threshold, tile=tile).collect()
        assert len(got) == 2 * len(want) and {(r["left_name"], r["right_name"]): r["score"] for r in got if r["block"] == "one"} == want
        top = L.similar_name_pairs(*frames, threshold, best=2, tile=tile).collect()
        for x in {x for x, _ in want}:
            second = sorted((v for (a, _), v in want.items() if a == x), reverse=True)[:2][-1]
            got = {r["right_name"]: r["score"] for r in top if r["left_name"] == x and r["block"] == "two"}
            assert {y: v for (a, y), v in want.items() if a == x and v >= second}.items() <= got.items() <= {y: v for (a, y), v in want.items() if a == x}.items()
    i, j, _ = L._possible([key(x) for x in left[:120]], [key(x) for x in right[60:120]], 0.75)
    close = sum(ratio(x, y) >= 0.75 for x in left[:120] for y in right[60:120])
    assert len(i) <= close + 120 * 60 // 100


def test_report_files_hold_candidates_once_a_group(spark, tmp_path):
    key = F.col("id").cast("string")
    facilities = spark.range(200).select(
        F.sha2(key, 256).alias("facility_key"), F.when(F.col("id") % 4 == 0, "unmatched").otherwise("ambiguous").alias("match_status"), F.lit("Board").alias("organization_name"), key.alias("facility_name"),
        F.lit("School").alias("operation_type"), F.lit("1 Street").alias("street"), F.lit("City").alias("city"), F.lit("1").alias("board_number"), F.lit(2020).alias("latest_year"),
        F.lit(2).alias("candidate_count"), F.when(F.col("id") % 4 > 0, F.when(F.col("id") == 1, "none").otherwise("one")).alias("candidate_group"),
    )
    candidates = spark.range(300).select(F.lit("one").alias("candidate_group"), key.alias("school_number"), F.concat(F.lit('"Maple"; school '), key).alias("school_name"))
    rejected = spark.createDataFrame([], "source string, data_row long, reject_reason string, raw map<string,string>")
    paths = I.write_reports(str(tmp_path), I.review_list(facilities), candidates, rejected, spark.createDataFrame([("a", "b", 1)], "section string, label string, n long"))
    assert sum(x.stat().st_size for x in tmp_path.rglob("*.csv")) < 100_000  # 150 facilities x 300 candidates are more than 900,000 bytes
    read = lambda name: spark.read.csv(paths[name], header=True, escape='"', multiLine=True)
    rows = I.with_candidates(read("match-review"), read("match-candidates")).collect()
    whole = "; ".join(f'{i} "Maple"; school {i}' for i in range(300))
    assert len(rows) == 200 and {(r["candidate_group"], r["candidates"]) for r in rows} == {("one", whole), ("none", ""), (None, "")}


def test_lookup_meets_only_the_first_documents_of_equal_text(spark, monkeypatch):
    school = lambda i: ("Maple Grove School", f"maple-{i:03}", "Ottawa", "Board")
    schools = spark.createDataFrame([school(i) for i in range(300)] + [("Maple Ridge School", "ridge", "Ottawa", "Board")], "name string, slug string, city string, board_name string")
    documents = S.search_documents(schools, spark.createDataFrame([("Maple Grove School", "board")], "name string, slug string"))
    queries = spark.createDataFrame([("maple",), ("grove",), ("ridge",)], "text string")
    met = []
    scores = S.lookup_scores
    monkeypatch.setattr(S, "lookup_scores", lambda q, d: met.append(d.count()) or scores(q, d))
    rows = S.lookup(queries, documents).collect()
    assert met == [6 + 1 + 1 + 1]  # of 300 equal schools, one other, a board and a city
    found = {q: [(r["kind"], r["position"], r["href"]) for r in sorted(rows, key=lambda r: (r["kind"], r["position"])) if r["query"] == q] for q in ("maple", "grove", "ridge")}
    equal = [("school", i + 1, f"/schools/maple-{i:03}") for i in range(6)]
    assert found["maple"] == found["grove"] == [("board", 1, "/boards/board"), *equal] and found["ridge"] == [("school", 1, "/schools/ridge")]


def test_names_that_end_alike_are_compared_without_their_ending(monkeypatch):
    draw = random.Random(12)
    word = lambda n: "".join(draw.choices("abcdefghij", k=n))
    right = [f"{word(7)} {word(draw.randint(5, 7))} public school" for _ in range(700)]
    left = [x[:4] + x[5:] if i % 3 else f"{word(7)} {word(6)} public school" for i, x in enumerate(right[:250])] + ["abcd centre", "", " ", None, "é中 public school", word(90), word(230), right[0]]
    right += ["é中😀 public school", "", None, word(60) + " public school", left[-2][7:]]
    key = lambda x: " ".join(sorted((x or "").split()))
    frame = lambda names: pd.DataFrame({"block": "b", "name": names, "text": [key(x) for x in names]})
    monkeypatch.setattr(L, "CHUNK", 128, raising=False)
    monkeypatch.setattr(L, "HEAD", 6, raising=False)
    asked = []
    ratios = L.ratios
    monkeypatch.setattr(L, "ratios", lambda a, b, t: asked.append(len(a)) or ratios(a, b, t))
    for threshold, best in ((0.75, 3), (0.85, 2), (0.6, 1)):
        asked.clear()
        got = L._compared(threshold, best)(("b",), frame(left), frame(right))
        found = {(x, y): s for x, y, s in got[["left_name", "right_name", "score"]].itertuples(index=False)}
        assert len(found) == len(got)
        for x in left:
            scores = {y: difflib.SequenceMatcher(None, key(x), key(y)).ratio() for y in right if key(x) and key(y)}
            scores = {y: s for y, s in scores.items() if s >= threshold}
            least = sorted(scores.values(), reverse=True)[:best][-1] if scores else 0
            assert {y: s for (a, y), s in found.items() if a == x} == {y: s for y, s in scores.items() if s >= least}
        assert sum(asked) < len(left) * len(right) // 10
    table = L._Subsequences([x for x in right[:700] if x])
    assert all(ending.startswith("loohcs cilbup ") and table._masks(some, len(ending))[0].itemsize == 2 for _, some, ending, _ in table.chunks)


def test_names_are_made_by_all_tasks(spark):
    rows = spark.createDataFrame([(f"School {k}", "1 Main St.", "Ottawa") for k in range(50)], "name string, street string, city string").coalesce(1)
    keyed = L.linkage_keys(rows, "name")
    assert keyed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r["name"], r["_name"]) for r in keyed.collect()} == {(f"School {k}", f"school {k}") for k in range(50)}

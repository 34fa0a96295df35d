"""Source mix, Merkle manifest and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peerscope.llm import infill, manifest, mixing

DRAW = random.Random(31)
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, `a.b` int, slot long, row int, n int"
EXTRA = ("x", 1, 2, 3, 4)


def rows():
    texts = [None, "", "\n", "a", "a\n", "\n\n\nb", "<P> x", "a<", "<S\n>P>\n<", "é\n中\n😀" * 50, "x" * 100_000, "one two\tthree\x0bfour" * 400]
    texts += ["".join(DRAW.choices("ab\né中😀 <>SPM", k=DRAW.randint(0, 80))) for _ in range(500)]
    out = [(i, t, DRAW.choice([None, "", "en", "en", "en", "é", "zz"]), DRAW.choice([None, "", "a", "b", "b", "b", "é"]), DRAW.choice([None, 3, -4]), *EXTRA) for i, t in enumerate(texts)]
    return out + [(None, "q\nr\n", "en", "b", 1, *EXTRA), (None, "q\nr\n", "en", "b", 1, *EXTRA), (3, "zz\nz", None, None, None, *EXTRA), out[9], out[9]]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def cut(doc_id, text, unit, rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    drawn = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), out[0], len(p), len(m), out[1], text


@pytest.mark.parametrize("unit, rate, batch", [("line", 100, 1 << 22), ("character", 60, 1 << 22), ("line", 100, 100)])
def test_fill_in_middle(docs, monkeypatch, unit, rate, batch):
    monkeypatch.setattr(infill, "BATCH_BYTES", batch)
    got = infill.fill_in_middle(docs, unit, rate).select("*", infill.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(map(tuple, got)) == Counter(cut(r[0], r[1], unit, rate) for r in ROWS)
    assert infill.fill_in_middle(docs.filter("false")).count() == 0


def test_markers_that_could_arise_are_refused(docs):
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, markers=("<P>", "<S>", "><"))


def test_sliced_batches(spark):
    texts = ["é\n" * (i % 5) + "x" * (i % 3) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").filter("doc_id % 2 = 1").coalesce(1)
    got = Counter(tuple(r) for r in infill.fill_in_middle(docs).select("*", "output").drop("output").collect())
    assert got == Counter(cut(i, t, "line", 100)[:5] for i, t in enumerate(texts) if i % 2)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, k):
    """(what remains, [(before, after) from the leaf up] of each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + k] for i in range(0, len(nodes), k)]
        for path, a in zip(paths, at, strict=True):
            path.append(("".join(runs[a // k][: a % k]), "".join(runs[a // k][a % k + 1 :])))
        nodes, at = [sha("".join(r)) for r in runs], [a // k for a in at]
    return nodes[0], paths


def proofs(table, k):
    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = {}
    for i, text, lang, source, n, *_ in table:
        now = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), leaf(i, source, lang, now, text), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], k) for g in order]
    root, upper = tree([top for top, _ in done], k) if done else (None, [])
    for g, (top, paths), up in zip(order, done, upper, strict=True):
        for (_, _, hash, now, i), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            found = now
            for before, after in path + up:
                found = sha(before + found + after)
            yield i, hash, top, root, sha("".join(a + b for a, b in path + up)), found, found == root


@pytest.mark.parametrize("size, k, digits", [(len(ROWS), 2, 10), (len(ROWS), 3, 2), (200, 2, 3), (1, 2, 10), (0, 2, 10)])
def test_manifest(spark, size, k, digits):
    table = spark.createDataFrame(ROWS[:size], SCHEMA).repartition(2)
    found = manifest.document_manifest(table, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, k, digits)
    got = found.select("doc_id", "leaf", "subroot", "root", manifest.siblings(F.col("path")), "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(proofs(ROWS[:size], k))


def test_manifest_hands_columns_through(spark):
    table = spark.createDataFrame([("g", i, sha(str(i)), i, "x", 0) for i in range(40)], "by string, key int, hash string, `a.b` int, row string, path int")
    with pytest.raises(Exception, match="(?i)ambiguous|duplicate|exists"):
        manifest.manifest(table).select("path").collect()
    found = manifest.manifest(table.drop("path")).collect()
    assert {(r["key"], r["a.b"], r["row"]) for r in found} == {(i, i, "x") for i in range(40)} and {len(r["path"]) for r in found} == {6}


def sizes_of(table):
    return [len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in table]


def levels(totals, weights, share, most):
    """Targets by resharing what lies above a cap until nothing does."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    found, capped = {}, set()
    while True:
        left = share * sum(totals.values()) - sum(most * totals[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        found = {s: most * totals[s] if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if found[s] > most * totals[s]}
        if not above:
            return found
        capped |= above


@pytest.mark.parametrize("block", [1024, 7])
def test_mix(docs, block):
    sizes = sizes_of(ROWS)
    totals = Counter()
    for r, n in zip(ROWS, sizes, strict=True):
        totals[r[3]] += n
    want = levels(totals, (5, 2, 1), 1.5, 2)
    got = mixing.mixed_documents(docs, block_words=block)
    taken, found = Counter(), got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], n) for r, n in zip(ROWS, sizes, strict=True))
    assert Counter(r["source_size"] for r in found) == Counter(totals[r[3]] for r in ROWS)
    assert sorted(r["target"] for r in found) == pytest.approx(sorted(want[r[3]] for r in ROWS))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    for r in found:
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(words - target) <= 1 for (target, _), words in taken.items())
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mixed_documents(docs.repartition(5), block_words=block).collect()))
    parts = mixing.mix(docs, block_words=block).collect()
    by_slot = {}
    for r in parts:
        by_slot.setdefault(r["slot"], []).append(r)
    for slot in by_slot.values():  # a slot is one block: its words follow each other without gaps
        slot.sort(key=lambda r: r["place"])
        assert len({r["source"] for r in slot}) == 1 and slot[0]["place"] == 0
        assert all(a["place"] + a["n_words"] == b["place"] for a, b in zip(slot, slot[1:], strict=False))
        assert sum(r["n_words"] for r in slot) <= block
    order = sorted(by_slot)
    first = {}
    for slot in order:  # blocks of a source come in their order
        source, block_number = by_slot[slot][0]["source"], by_slot[slot][0]["block"]
        assert block_number == first.get(source, 0)
        first[source] = block_number + 1
    if block == 7:  # any stretch of the schedule has each source's share, to within a few blocks
        for cut_at in (len(order) // 3, len(order) // 2):
            seen = Counter(by_slot[s][0]["source"] for s in order[:cut_at])
            assert all(abs(seen[s] - first[s] * cut_at / len(order)) <= 12 for s in first)


def test_mix_of_odd_tables(spark, docs):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed_documents(docs.filter("false")).count() == 0 and mixing.mix(docs.filter("false")).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", "a"), (None, "", None)], schema)
    assert sorted((r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mixed_documents(empty).collect()) == [(0, 0, 0.0, 0)] * 3
    one = spark.createDataFrame([(1, "a b c d", "a")], schema)
    assert [tuple(r) for r in mixing.mixed_documents(one).collect()] == [(1, 4, 4, 6.0, 6)]


def test_points_below(spark):
    for bits in (0, 1, 6):
        n = 1 << bits
        grid = spark.range(n + 1).crossJoin(spark.range(n + 1).toDF("bound"))
        for r in grid.select("id", "bound", mixing.points_below(F.col("id"), mixing.steps_below(F.col("bound"), bits)).alias("n")).collect():
            assert r["n"] == sum(int(format(i, f"0{bits}b")[::-1] if bits else "0", 2) < r["bound"] for i in range(r["id"]))

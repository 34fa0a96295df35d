"""Duplicates, similarity, repeated passages, neighbours, language and scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peerscope.llm import components, exact_dedup, language, language_model, nearest, ngram_join, substring_dedup
from peerscope.llm.common import held_out

DRAW = random.Random(9)
VOCABULARY = ["".join(DRAW.choices("abcdefghij", k=DRAW.randint(2, 7))) for _ in range(800)]


def prose(n, draw=DRAW):
    return " ".join(draw.choices(VOCABULARY, k=n))


def edited(text, changes, draw=DRAW):
    words = text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = draw.choice(VOCABULARY)
    return " ".join(words)


def corpus():
    base, other = prose(120), prose(90)
    texts = [base, other, *(edited(base, DRAW.randint(1, 6)) for _ in range(40)), *(edited(other, 2) for _ in range(6))]
    texts += [prose(60) for _ in range(20)] + [base, base.upper(), other.replace(" ", "\n\t"), None, "", " \n", "two words", "Two  words", "x", "a" * 20_000, prose(6000)]
    passage = prose(70)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(5)] + [passage[:60], "ﬁ É\xa0x\x1cy z w v u"]
    return texts


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", i, "x", False) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en", None, None, None, None), (0, TEXTS[0], "en", "s", 0, "x", True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean").repartition(4)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.filter("false")


def all_rows():
    return [*enumerate(TEXTS), (None, TEXTS[0]), (0, TEXTS[0])]


def test_exact_duplicates(docs, no_docs):
    body = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in all_rows():
        groups.setdefault(body(t), []).append(i)
    want = Counter()
    for i, t in all_rows():
        ids = groups[body(t)]
        keep = min(x for x in ids if x is not None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(body(t).encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == want
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for (i, _, _, stays, _), n in want.items() if stays for _ in range(n))
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def brute_components(percent=75):
    sets = {}
    for n, (i, t) in enumerate(all_rows()):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = [i for i, _ in all_rows()]
    smallest = {}
    for n, i in enumerate(ids):
        if i is not None:
            smallest[find(n)] = min(i, smallest.get(find(n), i))
    return Counter((i, len(sets[n]), smallest.get(find(n))) for n, i in enumerate(ids))


@pytest.mark.parametrize("chunk", [1000, 6])
def test_ngram_join(docs, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", chunk)
    monkeypatch.setattr(ngram_join, "SHARED", 2)
    rows = ngram_join.similar_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components()
    if chunk == 1000:
        assert ngram_join.similar_components(no_docs).count() == 0
        left = {r["doc_id"] for r in ngram_join.drop_similar(docs).collect()}
        assert left == {i for i, _, c in brute_components() if i is None or c == i}


def test_ngrams_that_meet_by_few_bits_are_compared_whole(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "MEETING_BITS", 6)  # some sixteen different keys among the prefixes: nearly all n-grams meet wrong ones
    rows = ngram_join.similar_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components()


def test_trie_links_equal_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(60):
        base = draw.choice(60, 30, replace=False)
        sets = [np.unique(np.where(draw.random(30) < 0.15, draw.integers(0, 300, 30), base)).astype(np.uint64) for _ in range(12)]
        sets += [np.unique(draw.integers(0, 40, draw.integers(1, 30))).astype(np.uint64) for _ in range(8)]
        got = ngram_join.linked(sets, 75)
        parent = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = parent[i], parent[j]
                    parent = [min(a, b) if p in (a, b) else p for p in parent]
        assert got == parent


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: parent[x] for x in linked}


def test_chunks_end_between_characters():
    for text in ["é" * 2000, "a" * 3000, "中" * 700, prose(500), ""]:
        data = text.encode()
        ends = substring_dedup.chunk_ends(np.frombuffer(data, dtype=np.uint8)).tolist()
        parts = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
        assert "".join(parts) == text and all(len(p.encode()) <= substring_dedup.LONGEST for p in parts)


def test_repeated_passages(spark, docs, no_docs):
    passage = " ".join(prose(60).split())
    shared = [f"{prose(50)}\n{passage} {prose(20)}", passage, f"{prose(10)} {passage}", prose(80), f"{prose(5)} {passage[:60]} {prose(30)}"]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(shared)], "doc_id long, text string, start long")
    spans = substring_dedup.repeated_spans(table).collect()
    assert {r["doc_id"] for r in spans} == {1, 2} and {r["first_doc_id"] for r in spans} == {0}
    after = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeated(table).collect()}
    assert [after[i] == shared[i] for i in range(5)] == [True, False, False, True, True]
    for i in (1, 2):
        left = Counter(after[i].split())
        assert sum(left.values()) < len(shared[i].split()) - 30 and not left - Counter(shared[i].split())
    same = substring_dedup.cut_repeated(docs)
    assert same.columns == docs.columns and same.count() == docs.count()
    assert substring_dedup.repeated_spans(no_docs).count() == 0


def test_passages_without_blanks_are_cut():
    before, passage, after = "中文" * 40, "日本語の文章" * 20, "ไทย" * 40
    at, length = len(before.encode()), len(passage.encode())
    assert substring_dedup.without(before + passage + after, [(at, length)]) == before + after
    assert substring_dedup.without(before + passage + after, [(at + 1, length - 2)]) == before + passage[0] + passage[-1] + after  # inside of characters
    assert substring_dedup.without(f"{before} x{passage}y {after}", [(at + 2, length)]) == f"{before} xy {after}"
    assert substring_dedup.without("one two three four", [(2, 13)]) == "one four"


def test_phrases_of_different_documents_are_no_passage(spark):
    draw = random.Random(12)
    clean = prose(300, draw).split()
    slices = [f"{prose(20, draw)} {' '.join(clean[i : i + 16])[:99].rsplit(' ', 1)[0]} {prose(20, draw)}" for i in range(0, 300, 4)]
    table = spark.createDataFrame([*enumerate(slices), (1000, " ".join(clean)), (1001, f"{prose(9, draw)} {' '.join(clean[50:150])}")], "doc_id long, text string")
    spans = substring_dedup.repeated_spans(table).collect()
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans} == {(1001, 1000)}


def test_passages_are_found_to_their_ends(spark):
    draw = random.Random(13)
    rows, want = [], {}
    for n in range(0, 200, 2):
        passage = prose(draw.randint(35, 50), draw)
        before, after = prose(draw.randint(1, 30), draw), prose(draw.randint(1, 30), draw)
        rows += [(n, f"{prose(draw.randint(1, 30), draw)}\n{passage} {prose(9, draw)}"), (n + 1, f"{before} {passage}\t{after}")]
        want[n + 1] = (len(before) + 1, len(passage), n)
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: (r["start"], r["length"], r["first_doc_id"]) for r in spans}
    assert len(spans) == len(want) == 100 and all(len(rows[n + 1][1]) > 100 for n in range(0, 200, 2))
    for i, (start, length, first) in want.items():
        at, size, keeper = found[i]
        assert keeper == first and at <= start and at + size >= start + length and size <= length + 20  # a word next to it may be the same by chance


def test_spans_stand_whole_in_an_earlier_document(spark):
    texts = [t or "" for t in TEXTS]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    whole = {}
    for r in spans:
        data = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]]
        assert len(data) >= 100 and r["first_doc_id"] < r["doc_id"] and data in texts[r["first_doc_id"]].encode()
        whole.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    for i, text in enumerate(texts):  # every window of whole words, by brute force
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)] if text.isascii() and len(text) < 3000 else []
        for a, _ in words:
            b = next((e for _, e in words if e - a >= 100), None)
            if b and any(re.search(rf"(?<!\S){re.escape(text[a:b])}(?!\S)", other) for other in texts[:i]):
                assert whole.get(i, set()) >= set(range(a, b)), (i, a, b)


def test_nearest(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 24)) * draw.uniform(0.5, 2, (600, 1))
    x[300:340] = x[7]  # a large class of equal vectors
    rows = [(i, v.tolist(), "l", 0.5) for i, v in enumerate(x)]
    out = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, []), (None, x[3].tolist()), (9006, [math.inf] * 24)]
    table = spark.createDataFrame(rows + [(i, v, "l", 0.5) for i, v in out] + rows[:2], "vec_id long, embedding array<double>, label string, score double").repartition(3)
    got = {}
    for r in nearest.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == set(range(0, 600, 20))
    for q, found in got.items():
        found.sort()
        scores = x @ x[q]
        want = [i for i in np.lexsort((np.arange(600), -scores.round(9))) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        assert [i for _, i, _ in found] == sorted((i for _, i, _ in found), key=lambda i: (-round(scores[i], 9), i))
        hits += len({i for _, i, _ in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    assert nearest.nearest(table.filter("false")).count() == 0
    few = nearest.nearest(table.filter("vec_id in (0, 20, 300)")).collect()
    assert Counter(r["query_id"] for r in few) == {0: 2, 20: 2, 300: 2}


def test_nearest_with_split_buckets_and_two_axes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 8)
    x = np.random.default_rng(2).normal(size=(500, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in nearest.nearest(table).collect():
        scores = x @ x[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        hits += r["vec_id"] in np.argsort(-scores)[:20]
    assert hits / (20 * 25) >= 0.9


def test_language(spark, docs, no_docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language.train(table, ~held_out("doc_id", 4))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 — 34"), (4, "Ω"), (None, "the of and")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, filters).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4] == ("en", 0.0) and got[None][0] == "en"
    found = language.identify(table, filters).join(table.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id", 4)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.97 and all(0 <= r["score"] <= 1 for r in found)
    empty = language.train(no_docs, ~held_out("doc_id", 4))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(no_docs, empty).count() == 0


def test_filters_return_all_languages_of_an_ngram():
    many = {f"l{i:02}": language.ngrams(prose(30, random.Random(i))) for i in range(70)}
    filters = language.Filters(many, dict.fromkeys(many, 1))
    for name, grams in many.items():
        assert filters.shares(grams)[filters.languages.index(name)] == 1


def test_scores(docs, no_docs):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]
    learned = [(i, t) for i, t in all_rows() if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    learned = [x for x in learned if x[0] is not None]  # the remainder of no id is null
    c = Counter(w for _, t in learned for w in words(t))
    total, distinct = sum(c.values()), len(c)
    got = language_model.score(docs, ~held_out("doc_id", 7)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == Counter((i, len(words(t)), sum(w in c for w in words(t)), total) for i, t in all_rows())
    texts = dict(all_rows())
    for r in got:
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words(texts[r["doc_id"]]))
        assert abs(r["base_score"] - base) < 1e-9 * max(1, -base) and r["score"] < 0
    assert language_model.score(no_docs, ~held_out("doc_id", 7)).count() == 0
    unknown = language_model.score(docs, held_out("doc_id", 7) & ~held_out("doc_id", 7)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in unknown} == {(0, 0)}


def test_noise_units_of_a_step():
    assert language_model.NOISE == 128  # a parameter of the training, not of its speed


def test_probabilities_sum_to_one(docs):
    counts = language_model.count_tokens(docs, "text")
    model = language_model.vocabulary(counts, frequent=200, single=40, bands=8)
    model.weights = language_model.train(docs, "text", model)
    n = len(model.log_units)
    units = np.arange(n)
    within = np.bincount(model.unit, 10.0**model.within, minlength=n)
    others = counts.count() - len(model.tokens)
    rest = int(counts.groupBy().sum("c").first()[0] - model.counts.sum()) + others + 1
    within[-1] = rest / model.other_mass
    for last, before in [(0, 0), (3, n - 1), (n - 1, 7)]:
        p = 10.0 ** language_model.Scorer(model)(np.full(n, last), np.full(n, before), units)
        used = within > 0
        assert abs(p.sum() - 1) < 1e-4 and abs(within[used] - 1).max() < 1e-9


def test_pipeline_stages(spark, docs, no_docs):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "")
            assert out.schema.simpleString() == spark.createDataFrame([], columns).schema.simpleString()
            assert out.count() <= table.count()


def test_pipeline_keeps_what_is_new(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    identified = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        identified = stage(spark, identified, folder)
    assert ids == {r["doc_id"] for r in identified.collect()}
    exact = {r["doc_id"] for r in exact_dedup.exact_duplicates(table).filter("kept").collect()}
    assert ids <= exact


def test_stages_allow_any_column_names(spark):
    names = ["doc_id", "text", "a.b", "__id", "__digest", "__dropped", "__spans", "key", "spans", "least", "dropped", "digest", "id", "block", "n"]
    passage = prose(70)
    rows = [(i, t, *[f"{i}-{k}" for k in range(len(names) - 2)]) for i, t in enumerate([f"{prose(30)} {passage}", f"{passage} {prose(30)}", "same", "same", None, "", prose(9)])]
    rows.append((None, "same", *rows[0][2:]))
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    filters = language.train(table.withColumn("lang", F.lit("en")), F.lit(True))
    kept = {
        "language": language.keep_identified(table, filters, 0.2),
        "exact": exact_dedup.drop_exact_duplicates(table),
        "near": ngram_join.drop_similar(table),
        "substrings": substring_dedup.cut_repeated(table),
    }
    for stage, out in kept.items():
        assert out.columns == names, stage
        for r in out.collect():
            assert r["doc_id"] is None or tuple(r)[2:] == rows[r["doc_id"]][2:], stage
    after = {r["doc_id"]: r["text"] for r in kept["substrings"].collect()}
    assert after[0] == rows[0][1] and passage not in after[1] and after[1] in rows[1][1]


def test_rows_that_repeat_an_id_are_cut_by_their_smallest_text(spark):
    passage, other = prose(60), prose(60)
    smallest, larger = f"a {passage}", f"z {other} {passage}"
    table = spark.createDataFrame([(1, passage), (2, larger), (2, smallest), (2, smallest), (3, other)], "doc_id long, text string")
    assert {(r["doc_id"], r["first_doc_id"]) for r in substring_dedup.repeated_spans(table).collect()} == {(2, 1)}
    assert Counter(r["text"] for r in substring_dedup.cut_repeated(table).collect() if r["doc_id"] == 2) == Counter([larger, "a ", "a "])


def test_chunks_resist_insertions():
    draw = random.Random(21)
    body = prose(400, draw).encode()
    for at in (0, 700, len(body) // 2):
        changed = body[:at] + b" inserted words " + body[at:]
        chunks = []
        for data in (body, changed):
            ends = substring_dedup.chunk_ends(np.frombuffer(data, dtype=np.uint8)).tolist()
            chunks.append({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})
        assert len(chunks[0] - chunks[1]) <= 6 and len(chunks[0]) > 60


def test_every_passage_of_the_least_length_holds_a_chunk():
    draw = np.random.default_rng(5)
    for _ in range(300):
        passage = draw.integers(97, 123, 100, dtype=np.uint8)
        digests = []
        for _ in range(2):
            data = np.concatenate([draw.integers(97, 123, draw.integers(0, 80), dtype=np.uint8), passage, draw.integers(97, 123, draw.integers(0, 80), dtype=np.uint8)])
            digests.append(set(substring_dedup.chunk_rows(data, np.array([0]), np.array([len(data)]), 100)[4].tolist()))
        assert digests[0] & digests[1]

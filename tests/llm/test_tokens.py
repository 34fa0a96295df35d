"""Token ids, bit packing, sequence packing, sampled pieces and piece counts against the libraries and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from peerscope.llm import packing, piece_counts, sampled_pieces, token_files
from peerscope.llm.pieces import MARK, load_pieces
from peerscope.llm.tokens import Encoder

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["a", "Be", "don't", "'S", "'", "é", "À", "ß", "12", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", ".", ",x", "é", "中", "ﬁ", "İ", "Σ", "<|endoftext|>", "<|", "😀", "▁", "￿"]


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 25))) for _ in range(n)]


TEXTS = [None, "", " ", "one", "one", "Two words.\nAnd  more", "x" * 5000, "word " * 3000, *odd_texts(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, -1, -1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", -1, -1, "x"), (3, "one", -1, -1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens long, ids string").repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.filter("false")


def library_ids(path, text):
    whole = Tokenizer.from_file(path)
    return whole.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("path,keeps_space", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_encoder_equals_library(path, keeps_space):
    encode, whole = Encoder(path, keeps_space, limit=50), Tokenizer.from_file(path)
    for text in [*odd_texts(3000), "It's what they've said: we'll see.", "a\n\n b \n", "a <|endoftext|> b", "<|ENDOFTEXT|>", "x<|startoftext|>y"]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bits_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    offsets, payload = token_files.pack_blocks(ids, bits)
    assert len(payload) <= (len(ids) + 63) // 64 * 8 * bits
    for start, count in [(0, 10_001), (4095, 2), (4096, 4096), (10_000, 1), (5, 0)]:
        assert (token_files.ids_at(payload, offsets, bits, start, count) == ids[start : start + count]).all()


def test_token_files(spark, docs, no_docs, tmp_path):
    token_files.write_token_files(docs, f"{tmp_path}/a", WORD_BPE)
    segments = token_files.read_token_files(spark, f"{tmp_path}/a")
    assert segments.first()["bits"] == 16
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.documents_in(segments).collect())
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    ids = sorted([i for i in texts if i is not None] + [3])
    start, want = 0, []
    for i in [None, *ids]:
        tokens = np.array(library_ids(WORD_BPE, texts[i]), dtype="<u4")
        want.append((start, i, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert got == want
    token_files.write_token_files(no_docs, f"{tmp_path}/b", WORD_BPE)
    assert token_files.documents_in(token_files.read_token_files(spark, f"{tmp_path}/b")).count() == 0


def test_packing(docs, no_docs):
    rows = packing.pack(docs, BYTE_BPE, capacity=128, carry=2, fan=2).collect()
    whole = {i: np.array(library_ids(BYTE_BPE, t), dtype="<u4") for i, t in [*enumerate(TEXTS), (None, "no id")]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
    for i, ids in whole.items():
        found = sorted(pieces[i], key=lambda r: r["piece"])
        if i == 3:  # this row is there twice
            assert [(r["start"], r["length"]) for r in found] == [(0, len(ids))] * 2
            continue
        assert [r["length"] for r in found[1:]] == [128] * (len(found) - 1) and sum(r["length"] for r in found) == len(ids)
        assert len(found) == -(-len(ids) // 128)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(map(len, whole.values())) + len(whole[3])
    assert len(sequences) <= total / 128 * 1.05 + 1
    assert packing.pack(no_docs, BYTE_BPE).count() == 0


def test_packing_does_not_depend_on_how_documents_are_dealt(spark):
    draw = random.Random(8)
    rows = [(i, "a " * (draw.randint(148, 158) if i < 600 else draw.randint(88, 96))) for i in range(1200)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")  # two parts of long texts, two of short ones
    found = packing.pack(table, BYTE_BPE, capacity=256).collect()
    assert len(found) == 1200 and {r["piece"] for r in found} == {0}
    assert len({r["sequence_id"] for r in found}) == len(packing.best_fit([r["length"] for r in found], 256))


def planned(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best fit of so many pieces of each length: for a length, rows (first rank, first sequence, pieces in each sequence, offset).

    Groups of sequences with equal contents are split in three by a length at most, so the plan's size depends on ``capacity`` alone.
    """
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, sequences) by room left
    some, sequences, plan = 0, 0, {}

    def put(room: int, first: int, n: int) -> None:
        nonlocal some
        if room and n:
            groups[room].append((first, n))
            some |= 1 << room

    for size in sorted(counts, reverse=True):
        left, rank, rows = counts[size], 0, []
        while left:
            fitting = some >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first, n = groups[room].pop()
                if not groups[room]:
                    some ^= 1 << room
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // size))
                sequences += n
            each = room // size
            full = min(n, left // each)
            last = left - full * each if full < n else 0  # what goes into one more sequence
            for at, some_of, pieces in ((first, full, each), (first + full, min(last, 1), last)):
                if some_of:
                    rows.append((rank, at, pieces, capacity - room))
                    put(room - pieces * size, at, some_of)
                    rank, left = rank + some_of * pieces, left - some_of * pieces
            taken = full + min(last, 1)
            put(room, first + taken, n - taken)
        plan[size] = np.array(rows, dtype=np.int64)
    return plan


def sequences_of_one_best_fit(lengths, capacity):
    # the last sequence that any group of equal ones reaches
    last = 0
    for size, rows in planned(Counter(lengths), capacity).items():
        ranks = np.append(rows[1:, 0], Counter(lengths)[size]) - rows[:, 0]
        last = max(last, int((rows[:, 1] + -(-ranks // rows[:, 2])).max()))
    return last


@pytest.mark.parametrize("held", [1 << 17, 1500])
def test_rounds_come_close_to_one_best_fit(spark, monkeypatch, held):
    monkeypatch.setattr(packing, "HELD", held)
    draw = random.Random(18)
    rows = [(i, "a " * (draw.randint(560, 640) if i < 2500 else draw.randint(340, 400) if i < 5000 else draw.randint(1, 1500))) for i in range(6000)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")  # parts of long texts, parts of short ones
    found = packing.pack(table, BYTE_BPE).collect()
    fills = Counter()
    for r in found:
        fills[r["sequence_id"]] += r["length"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:], strict=False)) and places[0][1] == 0
    assert max(fills.values()) <= 1024 and len(fills) <= 1.01 * sequences_of_one_best_fit([r["length"] for r in found], 1024) + 1


def test_texts_that_fit_nowhere_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 50)
    table = spark.createDataFrame([(i, "a " * 60) for i in range(600)], "doc_id long, text string")
    found = packing.pack(table, BYTE_BPE, capacity=100).collect()
    assert len({r["sequence_id"] for r in found}) == len(found) == 600 * (1 + (found[0]["length"] > 100))


def test_planned_packing_equals_best_fit():
    for seed in range(40):
        draw = random.Random(seed)
        capacity = draw.choice([1, 7, 64, 1024])
        sizes = [draw.randint(1, draw.choice([capacity, -(-capacity // 3)])) for _ in range(draw.randint(1, 400))]
        fills = Counter()
        for size, n in Counter(sizes).items():
            rows = planned(Counter(sizes), capacity)[size]
            for rank in range(n):
                first, sequence, each, _ = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                fills[sequence + (rank - first) // each] += size
        assert sorted(fills.values()) == sorted(sum(sizes[i] for i in b) for b in packing.best_fit(sizes, capacity))


def test_best_fit_leaves_one_half_empty_bin():
    sizes = [random.Random(5).randint(1, 1024) for _ in range(3000)]
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert max(fills) <= 1024 and sum(f <= 512 for f in fills) <= 1


def test_sampled_pieces_are_lossless_and_keyed_by_row(docs, no_docs):
    encoded = sampled_pieces.encode_sampled(docs, PIECES)
    rows = {(r["doc_id"], r["text"]): r["ids_crc32"] for r in sampled_pieces.decode(encoded, PIECES).collect()}
    texts = {(i, t or "") for i, t in enumerate(TEXTS)} | {(None, "no id")}
    assert set(rows) == texts
    again = {r["doc_id"]: r["ids_crc32"] for r in sampled_pieces.encode_sampled(docs.repartition(1), PIECES).collect()}
    assert again == {i: crc for (i, _), crc in rows.items()}
    assert sampled_pieces.encode_sampled(no_docs, PIECES).count() == 0


def test_samples_follow_the_lattice():
    pieces = load_pieces(PIECES)
    word = MARK + "there"

    def ways(rest):
        return [()] if not rest else [(rest[:j], *more) for j in range(1, len(rest) + 1) if rest[:j] in pieces.ids for more in ways(rest[j:])]

    weights = {w: math.exp(0.5 * sum(pieces.log_p[p] for p in w)) for w in ways(word)}
    n = 40_000
    found = Counter(tuple(pieces.texts[i] for i in ids) for ids in sampled_pieces.sampled(sampled_pieces.Trie(pieces, 0.5), ["there"] * n, list(range(n))))
    for way, weight in weights.items():
        p = weight / sum(weights.values())
        assert abs(found[way] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_piece_counts(docs, no_docs):
    pieces = load_pieces(PIECES)

    def greedy(word):
        n = i = 0
        while i < len(word):
            fits = [j for j in range(i + 1, len(word) + 1) if word[i:j] in pieces.ids]
            n, i = (n + 1, fits[-1]) if fits else (n + len(word[i].encode()), i + 1)
        return n

    want = Counter()
    for i, t in [*enumerate(TEXTS), (None, "no id"), (3, "one")]:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]
        want[i, len(words), sum(greedy(MARK + w) if len(w) < 100 else sum(map(greedy, [MARK + w])) for w in words)] += 1
    assert Counter(map(tuple, piece_counts.piece_counts(docs, PIECES).collect())) == want
    assert piece_counts.piece_counts(no_docs, PIECES).count() == 0


def test_longest_match_pops_several_tokens():
    match = piece_counts.LongestMatch(["a", "ab", "b", "c", "abcdx", "cd", "bcd"])
    assert [match(w) for w in ["", "a", "abcd", "abcdx", "abcdab", "xyz", "é", "bc"]] == [0, 1, 2, 1, 3, 3, 2, 2]

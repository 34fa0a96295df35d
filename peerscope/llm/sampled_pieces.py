"""Sampled SentencePiece segmentations, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for each piece (or, for a character without a piece,
its bytes). As no piece reaches over the start of a word, the lattice falls apart at words: the forward filter of a word does
not depend on the rest of the text, so a batch filters each of its distinct words once, all words side by side, one
position after the other. Sampling runs backward from each word's end: an edge into a node is drawn in proportion to (mass before
it) x (its probability to the power alpha). A draw is a hash of the row's key, the word's number in the text and the step, so
a row gets the same pieces wherever, with whatever neighbours and however often it runs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import STEP, crc32_of, mixed
from peerscope.llm.pieces import MARK, Pieces, load_pieces

#: Stands for a literal mark of the text while pieces are looked up: a lone surrogate, which no text holds.
LITERAL = "\ud800"
UNITS = re.compile(f"{MARK}+[^{MARK}]*")
POINT = 21  # bits of a code point
UNITS_AT_ONCE = 100_000


class Trie:
    """The pieces' trie: a hash table from (node, code point) to nodes; per node its piece (or -1) and that piece's log weight."""

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces, self.alpha = pieces, alpha
        to, piece, weight = {}, [-1], [0.0]
        for text, log_p in pieces.log_p.items():
            node = 0
            for c in text:
                key = node << POINT | ord(c)
                if key not in to:
                    to[key] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                node = to[key]
            piece[node], weight[node] = pieces.ids[text], alpha * log_p
        self.slot_bits = (4 * len(to)).bit_length()
        self.keys, self.to = np.full((1 << self.slot_bits) + 64, -1, dtype=np.int64), np.full((1 << self.slot_bits) + 64, -1, dtype=np.int64)
        for key, slot in zip(to, self.slots(np.array(list(to), dtype=np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:  # the next free slot; the last ones are in reserve beyond the table
                slot += 1
            self.keys[slot], self.to[slot] = key, to[key]
        self.piece, self.weight = np.array(piece, dtype=np.int32), np.array(weight)
        self.first_byte = len(pieces.texts)  # codes from here on: a character (less this) as its bytes


    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * STEP) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def go(self, keys: np.ndarray) -> np.ndarray:
        """The node after each (node, code point), or -1."""
        slots = self.slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.to[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] += 1
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.to[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Lattices:
    """The filtered lattices of distinct words. Nodes of word w are its character positions plus w; edges are grouped by end node."""

    def __init__(self, trie: Trie, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = lengths.cumsum()
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        stop = ends[word].astype(np.int32)
        alive = np.arange(len(codes), dtype=np.int32)
        state, alone = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
        found = []
        for k in range(1, 1 + int(lengths.max(initial=0))):
            key = state << POINT | codes[alive + k - 1]
            to = trie.go(key)
            on = to >= 0
            alive, state = alive[on], to[on]
            hit = trie.piece[state] >= 0
            found.append((alive[hit], np.full(int(hit.sum()), k, dtype=np.int32), trie.piece[state[hit]], trie.weight[state[hit]]))
            if k == 1:
                alone[alive[hit]] = True
            more = alive + k < stop[alive]
            alive, state = alive[more], state[more]
            if not len(alive):
                break
        rest = np.flatnonzero(~alone).astype(np.int32)
        points = np.where(codes[rest] == ord(LITERAL), ord(MARK), codes[rest])
        found.append((rest, np.ones(len(rest), dtype=np.int32), (trie.first_byte + points).astype(np.int32), trie.alpha * trie.pieces.byte_log_p * utf8_length(points)))
        start, length, self.code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        self.source = start + word[start]
        target = self.source + length
        level = start + length - (ends - lengths).astype(np.int32)[word[start]]
        order = np.argsort(level * np.int64(len(codes) + len(words) + 1) + target, kind="stable")
        self.source, self.code, weight, target, level = self.source[order], self.code[order], weight[order], target[order], level[order]
        self.first = np.flatnonzero(np.diff(target, prepend=-1))
        nodes = target[self.first]
        n_nodes = len(codes) + len(words)
        self.group = np.zeros(n_nodes, dtype=np.int64)
        self.group[nodes] = np.arange(len(nodes))
        self.last_node = ends + np.arange(len(words))
        self.is_start = np.zeros(n_nodes, dtype=bool)
        self.is_start[(ends - lengths) + np.arange(len(words))] = True
        mass = np.zeros(n_nodes)  # log of the sum over all ways to a node
        bounds = np.searchsorted(level[self.first], np.arange(1, 2 + int(lengths.max(initial=0))))
        edge_at = np.append(self.first, len(target))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, b = edge_at[low], edge_at[high]
            x, groups = mass[self.source[a:b]] + weight[a:b], self.first[low:high] - a
            top = np.maximum.reduceat(x, groups)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(groups, b - a)))), groups)
            mass[nodes[low:high]] = top + np.log(total)
        #: each group's probabilities sum to 1, so the running sum finds an edge by (group + draw)
        self.running = np.exp(mass[self.source] + weight - mass[target]).cumsum()
        self.last = edge_at[1:] - 1

    def sample(self, words: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, codes per occurrence) of occurrences: their words, their rows' keys and their numbers in their rows."""
        node, alive = self.last_node[words], np.arange(len(words))
        seeds = mixed(keys + mixed(numbers.astype(np.uint64) * STEP))
        steps = []
        while len(alive):
            draw = (mixed(seeds[alive] + np.array([len(steps) + 1], dtype=np.uint64) * STEP) >> np.uint64(11)) * 2.0**-53
            group = self.group[node]
            edge, last, aim = self.first[group], self.last[group], group + draw
            on = np.flatnonzero((self.running[edge] <= aim) & (edge < last))
            while len(on):  # a node has few edges
                edge[on] += 1
                on = on[(self.running[edge[on]] <= aim[on]) & (edge[on] < last[on])]
            steps.append((alive, self.code[edge]))
            node = self.source[edge]
            on = ~self.is_start[node]
            alive, node = alive[on], node[on]
        counts = np.zeros(len(words), dtype=np.int64)
        for who, _ in steps:
            counts[who] += 1
        ends = counts.cumsum()
        out = np.empty(int(counts.sum()), dtype=np.int64)
        for k, (who, code) in enumerate(steps):
            out[ends[who] - 1 - k] = code
        return out, counts


def utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def sampled(trie: Trie, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """The ids of each text; keys: 64-bit seeds of the rows."""
    out = [[] for _ in texts]
    units, owners, numbers = [], [], []

    def flush() -> None:
        distinct = {w: i for i, w in enumerate(dict.fromkeys(units))}
        words = np.fromiter(map(distinct.__getitem__, units), np.int64, len(units))
        who = np.array(owners).repeat([len(n) for n in numbers])
        codes, counts = Lattices(trie, list(distinct)).sample(words, np.array(keys, dtype=np.uint64)[who], np.concatenate(numbers))
        wide = np.where(codes >= trie.first_byte, utf8_length(codes - trie.first_byte), 1)
        ids = codes.repeat(wide)
        ends = wide.cumsum()
        bounds = np.append(0, ends)[np.append(0, counts.cumsum())]  # of occurrences among ids
        for at in np.flatnonzero(codes >= trie.first_byte).tolist():
            ids[ends[at] - wide[at] : ends[at]] = [trie.pieces.byte_ids[b] for b in chr(codes[at] - trie.first_byte).encode()]
        at = 0
        for owner, n in zip(owners, numbers, strict=True):
            out[owner].append(ids[bounds[at] : bounds[at + len(n)]])
            at += len(n)
        units.clear(), owners.clear(), numbers.clear()

    for owner, text in enumerate(texts):
        found = UNITS.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []
        for at in range(0, len(found), UNITS_AT_ONCE):
            part = found[at : at + UNITS_AT_ONCE]
            units.extend(part)
            owners.append(owner)
            numbers.append(np.arange(at, at + len(part)))
            if len(units) >= UNITS_AT_ONCE:
                flush()
    if units:
        flush()
    return [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]


def byte_table(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for."""
    table = [text.replace(MARK, " ").encode() for text in pieces.texts]
    for byte, i in enumerate(pieces.byte_ids):
        table[i] = bytes((byte,))
    return table


def decoded(ids: list[int], table: list[bytes]) -> str:
    """The text that was encoded."""
    return b"".join([table[i] for i in ids]).decode()[1:]


def encode_sampled(docs: DataFrame, model: str, alpha: float = 0.5, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, ids_crc32, text_crc32.

    Null texts count as empty, and empty texts have no ids. The generator is seeded by (seed, id), so rows that repeat an id
    and a text get the same ids. An empty table gives no rows; further columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(load_pieces(model), alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bodies = [x or "" for x in part.column(1).to_pylist()]
                ids = sampled(trie, bodies, [xxhash.xxh3_64_intdigest(f"{seed}:{key}") for key in part.column(0).to_pylist()])
                ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                sums = pa.array([crc32_of(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in bodies], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *sums], ["doc_id", "ids", "ids_crc32", "text_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(encode, "doc_id long, ids array<int>, ids_crc32 long, text_crc32 long")


def decode(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The same rows with the text of their ids (null ids: null) in place of the ids."""
    kept = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(load_pieces(model))
        for batch in batches:
            lists = batch.column(len(kept))
            texts = [decoded(x.values.to_numpy().tolist(), table) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, text])

    rows = encoded.select(*kept, ids)
    schema = rows.drop(ids).schema.add(text, "string")
    return rows.mapInArrow(run, schema)

"""Scores of whole texts: add-one word frequencies, and a log-bilinear neural model trained by noise-contrastive estimation.

Counts. Each task counts its words by 64-bit hash, the counts are combined by shuffle and stored. The ``frequent`` commonest
words (a fixed number) are what every task gets; each other word of a text is looked up by a join on its hash, once per
text and word, so no task needs the vocabulary and no common word becomes a hot key.

Model. Output units are the commonest words, one each, then bands of frequent words of similar count, then one unit for all
others. A unit's score after two units is bilinear in their vectors and its own plus a bias; exp(score) is normalised over
all units, and within a unit words share its mass by count + 1 (the last unit keeps one more for unknown words), so the
probabilities of all words and one unknown word sum to 1. Every training text is learned from: each task takes one pass of noise-contrastive steps over
its texts, from the same start, and the tasks' parameters are averaged by their numbers of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import words_by_text
from peerscope.session import materialize

END = 0  # fixed value: the end token's place among hashes; a word's hash is made odd, so none meets it
FREQUENT, SINGLE, BANDS, WIDTH, BATCH, NOISE, RATE = 65_536, 383, 64, 16, 4096, 128, 0.1


def tokens_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The token hashes of each text: its words, then the end."""
    for hashes in words_by_text(body.as_py() for body in column):
        yield np.append(hashes | np.uint64(1), np.uint64(END))


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, c) of all texts, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], ["token", "c"])

        for batch in batches:
            for hashes in tokens_of(batch.column(0)):
                waiting.append(hashes)
                size += len(hashes)
                if size >= 4_000_000:
                    yield counted()
                    waiting, size = [], 0
        if waiting:
            yield counted()

    return materialize(docs.select(text).mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))


@dataclass
class Model:
    tokens: np.ndarray  # frequent words, sorted by hash
    counts: np.ndarray
    unit: np.ndarray
    within: np.ndarray  # log10 of a word's share of its unit
    total: int  # N
    distinct: int  # V
    log_units: np.ndarray  # log of the units' training frequencies
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def other(self) -> int:
        return len(self.log_units) - 1

    @property
    def other_mass(self) -> int:
        """Sum of count + 1 over all words outside the frequent ones, and 1 for unknown words."""
        return int(self.total - self.counts.sum()) + self.distinct - len(self.tokens) + 1

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words, whether it is one) of each hash."""
        if not len(self.tokens):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return at, self.tokens[at] == hashes

    def units(self, hashes: np.ndarray) -> np.ndarray:
        at, is_frequent = self.places(hashes)
        return np.where(is_frequent, self.unit[at] if len(self.unit) else 0, self.other)


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, single: int = SINGLE, bands: int = BANDS) -> Model:
    """The frequent words with their units; the rest of the vocabulary only as sums."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(frequent).toArrow()
    tokens, c = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.lexsort((tokens, -c))
    tokens, c = tokens[order], c[order]
    rank = np.arange(len(c))
    band = np.floor(bands * np.log(np.maximum(rank, single) / single) / np.log(max(2.0, frequent / single))).astype(np.int64)
    unit = np.where(rank < single, rank, single + np.minimum(band, bands - 1))
    mass = np.bincount(unit, weights=c + 1.0, minlength=single + bands + 1)
    within = np.log10((c + 1.0) / mass[unit])
    mass[-1] = sums[0] - c.sum() + sums[1] - len(c) + 1.0
    by_hash = np.argsort(tokens)
    return Model(tokens[by_hash], c[by_hash], unit[by_hash], within[by_hash], int(sums[0]), int(sums[1]), np.log(np.maximum(mass, 1e-6) / mass.sum()))


def contexts(units: np.ndarray, starts: np.ndarray, start_unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one unit before each token; ``starts``: where texts begin."""
    last = np.empty_like(units)
    last[1:] = units[:-1]
    last[starts] = start_unit
    before = np.empty_like(units)
    before[1:] = last[:-1]
    before[starts] = start_unit
    return last, before


def start_weights(log_units: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    """Vectors from a fixed seed; the biases are the units' log frequencies."""
    random = np.random.default_rng(0)
    shape = (len(log_units), width)
    draw = lambda *size: random.normal(0, 0.1, size).astype(np.float32)
    eye = np.eye(width, dtype=np.float32)
    return {"in": draw(*shape), "out": draw(*shape), "last": eye + draw(width, width), "before": 0.5 * eye + draw(width, width), "bias": log_units.astype(np.float32)}


def summed(rows: np.ndarray, units: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by unit."""
    order = np.argsort(units, kind="stable")
    sorted_units = units[order]
    first = np.flatnonzero(np.diff(sorted_units, prepend=-1))
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[sorted_units[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def learn(w: dict[str, np.ndarray], squares: dict[str, np.ndarray], last: np.ndarray, before: np.ndarray, target: np.ndarray, noise: np.ndarray, log_units: np.ndarray) -> None:
    """One noise-contrastive step (Adagrad) on a batch; all its tokens share the noise units."""
    n, k = len(log_units), len(noise)
    log_units = log_units.astype(np.float32)
    a, b = w["in"][last], w["in"][before]
    h = a @ w["last"] + b @ w["before"]
    offset = np.float32(np.log(k)) + log_units
    true = (h * w["out"][target]).sum(1) + w["bias"][target] - offset[target]
    false = h @ w["out"][noise].T + w["bias"][noise] - offset[noise]
    g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # up for the word that is there
    g_false = -1 / (1 + np.exp(np.clip(-false, -30, 30)))  # down for noise
    g_h = g_true[:, None] * w["out"][target] + g_false @ w["out"][noise]
    g = {"out": summed(np.concatenate([g_true[:, None] * h, g_false.T @ h]), np.concatenate([target, noise]), n)}
    g["bias"] = np.bincount(target, g_true, n) + np.bincount(noise, g_false.sum(0), n)
    g["last"], g["before"] = a.T @ g_h, b.T @ g_h
    g["in"] = summed(np.concatenate([g_h @ w["last"].T, g_h @ w["before"].T]), np.concatenate([last, before]), n)
    for name, step in g.items():
        step = (step / len(target)).astype(np.float32)
        squares[name] += step * step
        w[name] += RATE * step / (np.sqrt(squares[name]) + 1e-8)


def train(docs: DataFrame, text: str, model: Model) -> dict[str, np.ndarray]:
    """Weights averaged over one pass of every task over its training texts."""
    begin = start_weights(model.log_units)
    names, shapes = list(begin), {k: v.shape for k, v in begin.items()}
    shared = docs.sparkSession.sparkContext.broadcast((model, begin))

    def flat(w: dict[str, np.ndarray]) -> bytes:
        return np.concatenate([w[k].reshape(-1) for k in names]).astype("<f4").tobytes()

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, begin = shared.value
        w = {k: v.copy() for k, v in begin.items()}
        squares = {k: np.full(v.shape, 1e-4, dtype=np.float32) for k, v in w.items()}
        random = np.random.default_rng(1 + TaskContext.get().partitionId())
        frequency = np.exp(model.log_units)
        frequency /= frequency.sum()
        seen, end_unit = 0, int(model.units(np.array([END], dtype=np.uint64))[0])
        for units, starts in batched(batches, model):
            last, before = contexts(units, starts, end_unit)
            order = random.permutation(len(units))
            noise = random.choice(len(frequency), size=(-(-len(units) // BATCH), NOISE), p=frequency)
            for i, at in enumerate(range(0, len(units), BATCH)):
                some = order[at : at + BATCH]
                learn(w, squares, last[some], before[some], units[some], noise[i], model.log_units)
            seen += len(units)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat(w)], pa.binary())], ["n", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["weights"], "<f4").astype(np.float64) * row["n"]
                total, n = part if total is None else total + part, n + row["n"]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["n", "weights"])

    parts = materialize(docs.select(text).mapInArrow(one_pass, "n long, weights binary"))
    tasks = parts.count()
    while tasks > 1:
        tasks = -(-tasks // 32)
        parts = materialize(parts.coalesce(tasks).mapInArrow(average, "n long, weights binary"))
        tasks = min(tasks, parts.count())
    found = parts.first()
    if found is None:
        return begin
    values, out, at = np.frombuffer(found["weights"], "<f4"), {}, 0
    for name in names:
        size = int(np.prod(shapes[name]))
        out[name] = values[at : at + size].reshape(shapes[name])
        at += size
    return out


def batched(batches: Iterator[pa.RecordBatch], model: Model, tokens: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, starts of texts) of whole texts, some 200,000 tokens at a time."""
    waiting, size = [], 0
    for batch in batches:
        for hashes in tokens_of(batch.column(0)):
            waiting.append(hashes)
            size += len(hashes)
            if size >= tokens:
                yield model.units(np.concatenate(waiting)), np.cumsum([0, *map(len, waiting[:-1])])
                waiting, size = [], 0
    if waiting:
        yield model.units(np.concatenate(waiting)), np.cumsum([0, *map(len, waiting[:-1])])


class Scorer:
    """Normalised log10 probabilities of units in context; a context's normaliser is computed once."""

    def __init__(self, model: Model):
        w = {k: v.astype(np.float32) for k, v in model.weights.items()}
        self.last, self.before, self.out, self.bias = w["in"] @ w["last"], w["in"] @ w["before"], w["out"], w["bias"]
        self.log_z = np.full(len(self.bias) ** 2, np.nan)

    def __call__(self, last: np.ndarray, before: np.ndarray, target: np.ndarray, rows: int = 8192) -> np.ndarray:
        n = len(self.bias)
        pairs = last * n + before
        new = np.unique(pairs[np.isnan(self.log_z[pairs])])
        for at in range(0, len(new), rows):
            some = new[at : at + rows]
            scores = (self.last[some // n] + self.before[some % n]) @ self.out.T + self.bias
            top = scores.max(1)
            self.log_z[some] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        h = self.last[last]
        h += self.before[before]
        score = np.einsum("ij,ij->i", h, self.out[target]) + self.bias[target]
        return (score - self.log_z[pairs]) / np.log(10)


DOCS = "row long, doc_id long, n_tokens long, n_frequent long, base double, model double, tokens array<long>, times array<long>"


def score(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text with A-Z in lower case, and one end; null counts as empty, so every document has its end. Rows that
    repeat are scored (and learned from) as often as they occur. Without training texts every word is unknown. An empty table gives no rows; further columns are ignored.
    Distinct words that share a 64-bit hash would be one word.
    """
    spark = docs.sparkSession
    training = docs.filter(learn_from)
    counts = count_tokens(training, text)
    model = vocabulary(counts)
    model.weights = train(training, text, model)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, end_unit = Scorer(model), int(model.units(np.array([END], dtype=np.uint64))[0])
        base = np.log10((model.counts + 1.0) / (model.total + model.distinct + 1))
        row = TaskContext.get().partitionId() << 33

        def scored(keys: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal row
            flat = np.concatenate(hashes)
            starts = np.cumsum([0, *map(len, hashes[:-1])])
            at, is_frequent = model.places(flat)
            units = np.where(is_frequent, model.unit[at] if len(model.unit) else 0, model.other)
            last, before = contexts(units, starts, end_unit)
            parts = scorer(last, before, units)
            bases = np.zeros(len(flat))
            bases[is_frequent] = base[at[is_frequent]]
            parts[is_frequent] += model.within[at[is_frequent]]
            others = [np.unique(h[~f], return_counts=True) for h, f in zip(hashes, np.split(is_frequent, starts[1:]), strict=True)]
            columns = [
                pa.array(range(row, row + len(keys)), pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array([len(h) for h in hashes], pa.int64()),
                pa.array(np.add.reduceat(is_frequent.astype(np.int64), starts)),
                pa.array(np.add.reduceat(bases, starts)),
                pa.array(np.add.reduceat(parts, starts)),
                pa.array([t.view(np.int64) for t, _ in others], pa.list_(pa.int64())),
                pa.array([n for _, n in others], pa.list_(pa.int64())),
            ]
            row += len(keys)
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_frequent", "base", "model", "tokens", "times"])

        keys, hashes, size = [], [], 0
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1)), strict=True):
                keys.append(key)
                hashes.append(found)
                size += len(found)
                if size >= 200_000:
                    yield scored(keys, hashes)
                    keys, hashes, size = [], [], 0
        if keys:
            yield scored(keys, hashes)

    scored = materialize(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, DOCS))
    rare = scored.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t")).select("row", "t.tokens", "t.times")
    found = rare.join(counts, F.col("tokens") == F.col("token"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1.0) / F.lit(float(model.total + model.distinct + 1)))).alias("base_rare"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1.0) / F.lit(float(model.other_mass)))).alias("model_rare"),
    )
    zero = F.lit(0.0)
    return (
        scored.drop("tokens", "times")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(model.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base_rare", zero)).alias("base_score"),
            (F.col("model") + F.coalesce("model_rare", zero)).alias("score"),
        )
    )

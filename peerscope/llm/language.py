"""Language identification by bit-sliced Bloom filters of letter n-grams.

Training counts every n-gram of every labelled text, per language. An n-gram belongs to a language if it makes up at least
``share`` of that language's n-grams, so a language keeps 1 / share n-grams at most, whatever the corpus's size. All languages share one table of
bit masks: a slot's bit l says that some n-gram of language l hashes there; the AND over an n-gram's slots gives all
languages that contain it at once. A text's hits per language, less the hits that the filter's fill makes by chance, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import STEP, mixed, numbered
from peerscope.session import materialize

SIZES = (3, 4)  # letters of an n-gram, word ends included
HASHES = 3

@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of all letter n-grams of a whole text, with one blank at either end of each word; none without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint64)
    codes = np.concatenate([[0], np.where(is_letter, codes, 0), [0]]).astype(np.uint64)
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
    found = []
    for n in SIZES:
        if len(codes) >= n:
            at = len(codes) - n + 1
            inner = np.ones(at, dtype=bool)
            for k in range(1, n - 1):
                inner &= codes[k : k + at] != 0
            total = np.full(at, n, dtype=np.uint64)
            for k in range(n):
                total = mixed((total + codes[k : k + at] + np.uint64(1)) * STEP)
            found.append(total[inner])
    return np.concatenate(found)


class Filters:
    """The languages' Bloom filters, bit-sliced: one row of masks per slot."""

    def __init__(self, per_language: dict[str, np.ndarray], prior: dict[str, int]):
        self.languages = sorted(per_language)
        self.fallback = min(self.languages, key=lambda x: (-prior[x], x)) if self.languages else "und"
        most = max([1, *map(len, per_language.values())])
        self.slots = 1 << int(4 * HASHES * most - 1).bit_length()  # a fill under a quarter for the largest language
        self.masks = np.zeros((self.slots, -(-len(self.languages) // 64) or 1), dtype=np.uint64)
        chance = []
        for i, name in enumerate(self.languages):
            word, bit = divmod(i, 64)
            for place in self.places(per_language[name]):
                np.bitwise_or.at(self.masks[:, word], place, np.uint64(1 << bit))
            chance.append(float((self.masks[:, word] >> np.uint64(bit) & np.uint64(1)).mean()) ** HASHES)
        self.chance = np.array(chance)

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = mixed(hashes + STEP) | np.uint64(1)
        return [((hashes + np.uint64(k) * step) & np.uint64(self.slots - 1)).astype(np.int64) for k in range(HASHES)]

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """Per language, the share of n-grams that it contains, corrected for chance hits."""
        first, *more = self.places(hashes)
        masks = self.masks[first]
        for place in more:
            masks &= self.masks[place]
        hits = np.array([int((masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).sum()) for i in range(len(self.languages))])
        return np.clip((hits / len(hashes) - self.chance) / (1 - self.chance), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = ngrams(text)
        if not len(hashes) or not self.languages:
            return ("und", 0.0) if not len(hashes) else (self.fallback, 0.0)
        shares = self.shares(hashes)
        best = int(shares.argmax())
        return (self.languages[best], float(shares[best])) if shares[best] > 0 else (self.fallback, 0.0)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", share: float = 5e-5) -> Filters:
    """Filters from the rows where ``learn`` holds and the language is not null; counts cover all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for name in sorted(set(names)):
                rows = np.flatnonzero(names == name)
                for at in range(0, len(rows), 500):
                    parts = [ngrams(batch.column(0)[int(i)].as_py()) for i in rows[at : at + 500]]
                    values, counts = np.unique(np.concatenate(parts), return_counts=True)
                    columns = [pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "ngram", "n"])

    rows = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).alias("lang"))
    counts = materialize(rows.select(text, "lang").mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n")))
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    kept = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= share * F.col("total")).select("lang", "ngram").toArrow()
    names, hashes = np.array(kept.column(0).to_pylist(), dtype=object), kept.column(1).to_numpy().view(np.uint64)
    return Filters({name: hashes[names == name] for name in prior}, prior)


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows' own columns ``doc_id`` with lang_pred and score.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null or has no letter. A text whose n-grams no
    language contains gets the language with most training texts and score 0; ties go to the name that sorts first. Repeated rows
    repeat; an empty table gives no rows; without training rows every text with a letter is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(body.as_py()) for body in batch.column(1)]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, least: float, text: str = "text") -> DataFrame:
    """The documents whose text is in a learned language with a score of ``least`` at least, with all their columns, whatever their names.

    Null and empty texts, and those without letters, go; rows that repeat stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(body.as_py()) for body in batch.column(at)]
            kept = pa.array([name != "und" and score >= least for name, score in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.filter(kept).columns, names)

    return numbered(docs).mapInArrow(run, docs.schema)

"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the contracts define it.
BLANKS = "\\x20\\x09-\\x0D"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: str, parts: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder 2."""
    return F.crc32(F.col(doc_id).cast("string")) % parts == 2


#: Odd multipliers of splitmix64 (fixed values).
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers, one for each number."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A-Z in lower case, and the blanks, among all bytes; random numbers for bytes and for their places in a word.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LONG_WORD = 64
BYTE = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE = np.random.default_rng(19).integers(0, 1 << 64, LONG_WORD, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in their order, words of each text): words with A-Z in lower case, by 64 bits; none for null.

    All texts are one array of bytes; a word's hash is a sum over its bytes and their places. A word beyond LONG_WORD bytes is hashed alone.
    """
    bodies = [text.encode() if text else b"" for text in texts]
    data = LOWER[np.frombuffer(b" ".join([*bodies, b""]), dtype=np.uint8)]
    ends_of_texts = np.cumsum([len(b) + 1 for b in bodies], dtype=np.int64)
    solid = ~BLANK[data]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    at = np.flatnonzero(solid)
    inner = np.minimum(at - np.repeat(starts, lengths), LONG_WORD - 1)
    sums = np.add.reduceat(BYTE[data[at]] * PLACE[inner], np.cumsum(lengths) - lengths)
    hashes = mixed(sums + lengths.astype(np.uint64) * STEP)
    for k in np.flatnonzero(lengths > LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return hashes, np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)


def words_by_text(texts: Iterable[str | None], together: int = 500_000) -> Iterator[np.ndarray]:
    """The hashes of each text's words, worked out for a bounded number of characters at a time."""
    waiting, size = [], 0
    for text in chain(texts, [None]):
        waiting.append(text)
        size += len(text or "")
        if size >= together:
            hashes, counts = word_hashes(waiting)
            yield from np.split(hashes, np.cumsum(counts)[:-1])
            waiting, size = [], 0
    if len(waiting) > 1:
        hashes, counts = word_hashes(waiting)
        yield from np.split(hashes, np.cumsum(counts)[:-1])[:-1]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def frame(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT = 1000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a stored table that has one row per key and the number of its rows.

    The HOT keys with the largest counts, and no more, are broadcast; any other key has at most one HOT-th of all rows, so no
    task of the sort-merge join gets one that is too large. The table grows with the rows, so it is never broadcast whole.
    """
    hot = table.orderBy(F.desc(count), key).limit(HOT)
    names = F.broadcast(hot.select(key))
    cold = rows.join(names, key, "left_anti").join(table.join(names, key, "left_anti").hint("merge"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Rows of a common key that one task gets.
SHARE_BITS = 14


def join_salted(rows: DataFrame, table: DataFrame, key: str, count: str, spread: str, share_bits: int = SHARE_BITS) -> DataFrame:
    """Inner join with a stored table that has one row per key and the number of its rows; adds ``salt`` and ``salts``.

    Rows of the HOT commonest keys are dealt over salts by a hash of ``spread``, one for each 2^share_bits of them, and the table has a copy for each;
    any other key has at most one HOT-th of all rows. Only those keys are broadcast, HOT at most, and ``rows`` is read once.
    """
    hot = table.filter(F.col(count) >= 1 << share_bits).orderBy(F.desc(count), key).limit(HOT)
    hot = F.broadcast(hot.select(key, (F.shiftright(count, share_bits) + 1).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64(spread), "salts"))
    copies = table.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return dealt.join(copies, [key, "salt"])


def numbered(df: DataFrame) -> DataFrame:
    """The table with its columns named by their places, for functions over batches: any names are allowed then, dots too."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table lacks."""
    known, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        found.append(name)
    return found

"""Token ids as fixed-width bit fields in files.

Format: Parquet files named in ascending document order; a row is a segment of whole documents:

* ``part, segment``: the writing task and the segment's number in it; ``start``: tokens of the same task before it;
* ``doc_ids`` and ``doc_ends``: its documents and the token positions where they end;
* ``bits``: width of an id, the fewest that hold every id of the vocabulary;
* ``payload``: little-endian 64-bit words; 64 ids take exactly ``bits`` words, so unpacking is whole-column arithmetic;
* ``block_offsets``: little-endian 64-bit byte offsets of the blocks of BLOCK ids (the last one padded to 64 ids), and the end.

Any run of tokens is read from the blocks that hold it. A segment is closed at SEGMENT tokens, so memory is bounded by
that and the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerscope.llm.common import crc32_of, partitions
from peerscope.llm.tokens import encoder

BLOCK, SEGMENT, END = 4096, 1 << 18, 2
SEGMENTS = pa.schema(
    [("part", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bits", pa.int32())]
    + [("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("block_offsets", pa.binary()), ("payload", pa.binary())]
)
SEGMENTS_DDL = "part long, segment long, start long, n_tokens long, bits int, doc_ids array<long>, doc_ends array<long>, block_offsets binary, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits: each 64 ids take ``bits`` words; the last 64 are padded with zeros."""
    rows = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(rows), bits), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    words = words.reshape(-1, bits)
    rows = np.empty((len(words), 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        rows[:, i] = value & mask
    return rows.reshape(-1)[:count]


def pack_blocks(ids: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """(block offsets, payload) of a segment's ids."""
    payload = pack_bits(ids, bits).astype("<u8").tobytes()
    offsets = np.minimum(np.arange(-(-len(ids) // BLOCK) + 1, dtype="<i8") * (BLOCK // 64 * bits * 8), len(payload))
    return offsets.astype("<i8").tobytes(), payload


def ids_at(payload: bytes, block_offsets: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start`` of a segment, reading only the blocks that hold them."""
    if count <= 0:
        return np.empty(0, dtype=np.uint32)
    offsets = np.frombuffer(block_offsets, dtype="<i8")
    first, last = start // BLOCK, (start + count - 1) // BLOCK
    low, high = int(offsets[first]), int(offsets[last + 1])
    words = np.frombuffer(payload, dtype="<u8", offset=low, count=(high - low) // 8)
    return unpack_bits(words, bits, start + count - first * BLOCK)[start - first * BLOCK :]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write every whole text's ids and an end id, in ascending id order (null ids first, repeated ids by text hash).

    A null or empty text is its end id alone; an empty table gives no segments; further columns are ignored. Texts are dealt
    by ranges of the id before they are encoded, so that each is encoded once.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False)
        bits = max(1, int(encode.whole.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        size = 0

        def closed() -> pa.RecordBatch:
            offsets, payload = pack_blocks(np.concatenate(ids), bits)
            row = {"part": part, "segment": number, "start": before, "n_tokens": size, "bits": bits, "doc_ids": list(keys)}
            row |= {"doc_ends": np.cumsum([len(x) for x in ids]).tolist(), "block_offsets": offsets, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENTS)

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(encode(body.as_py(), END))
                keys.append(key)
                size += len(ids[-1])
                if size >= SEGMENT:
                    yield closed()
                    number, before, size = number + 1, before + size, 0
                    ids.clear()
                    keys.clear()
        if ids:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(segments, SEGMENTS_DDL).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments, each with ``first_token``: the tokens of all segments before it.

    The join's small side has one row per writing task, which is what bounds its broadcast.
    """
    segments = spark.read.schema(SEGMENTS_DDL).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("part", F.coalesce(before, F.lit(0)).alias("tokens_before"))
    return segments.join(F.broadcast(parts), "part").withColumn("first_token", F.col("tokens_before") + F.col("start")).drop("tokens_before")


DOCUMENTS = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")])


def documents_in(segments: DataFrame) -> DataFrame:
    """One row per document read back: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_at(row["payload"], row["block_offsets"], row["bits"], 0, row["n_tokens"])
                ends = np.array(row["doc_ends"], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                sums = [crc32_of(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_token"]), pa.array(ends - starts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=DOCUMENTS)

    needed = segments.select("first_token", "n_tokens", "bits", "doc_ids", "doc_ends", "block_offsets", "payload")
    return needed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Best-fit packing of token pieces into sequences, by hierarchical rounds.

Documents are cut into pieces where they are read. The pieces are dealt over tasks by a hash, so that each task has pieces of all lengths,
however the documents lie; a task has ``HELD`` items at most and packs them by best fit, largest first. Bins that are at least
``FULL`` full are sequences. The others go on as items of the next round: ``fan`` tasks are merged into one, underfull bins are packed by best
fit among each other, and so on up the tree, until one task is left. If so many bins stay underfull that a single task cannot hold
them (texts whose lengths fit nowhere), rounds go on, dealt anew each time, while at least one bin in ``carry`` goes.
A row is a bin with the places of its pieces, so bins take their pieces along, and no join is needed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import crc32_of
from peerscope.llm.tokens import encoder
from peerscope.session import materialize

END = 2
PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN_DDL = "sequence_id long, fill long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
#: Items that a task packs at most (a million numbers), pieces that are written together, and per cent of the capacity of a finished bin.
HELD, WRITTEN, FULL = 1 << 17, 20_000, 97


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first one takes what is over."""
    first = length % capacity or min(length, capacity)
    ends = range(first, length + 1, capacity)
    return [(max(0, end - capacity) if i else 0, capacity if i else first) for i, end in enumerate(ends)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the bin that it fills best (ties: the oldest such bin)."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    some = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                some ^= 1 << room
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            open_bins[room].append(number)
            some |= 1 << room
    return bins


def _pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """The pieces of all documents, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(vocabulary, True), [[] for _ in PIECE]

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, PIECE, strict=True)], [name for name, _ in PIECE])
            for x in found:
                x.clear()
            return batch

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(body.as_py(), END)
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(found, (key, n, start, length, crc32_of(ids[start : start + length])), strict=True):
                        column.append(value)
                if len(found[0]) >= WRITTEN:
                    yield rows()
        if found[0]:
            yield rows()

    return docs.mapInArrow(run, PIECE_DDL)


def _binned(items: DataFrame, capacity: int, level: int, tasks: int) -> DataFrame:
    """One round: the bins (sequence_id, fill, pieces) of items of the same form, packed in so many tasks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table.column("fill").to_numpy()
        bins = best_fit(sizes.tolist(), capacity)
        order = np.fromiter((item for b in bins for item in b), np.int64, len(sizes))
        firsts = np.cumsum([0, *map(len, bins)])  # of each bin, among the ordered items
        taken = sizes[order]
        upto = np.concatenate([[0], np.cumsum(taken)])
        places = upto[:-1] - np.repeat(upto[firsts[:-1]], np.diff(firsts))
        lists = table.column("pieces").combine_chunks().take(pa.array(order))
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        offset = flat.field("offset").to_numpy() + np.repeat(places, lengths)
        members = pa.StructArray.from_arrays([*[flat.field(name) for name, _ in PIECE], pa.array(offset)], [*[name for name, _ in PIECE], "offset"])
        ends = np.concatenate([[0], np.cumsum(lengths)])[firsts]
        ids = (level << 56) + (key[0].as_py() << 32) + np.arange(len(bins))
        fills = np.add.reduceat(taken, firsts[:-1])
        return pa.table({"sequence_id": pa.array(ids), "fill": pa.array(fills), "pieces": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)})

    dealt = items.withColumn("task", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, BIN_DDL)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", carry: int = 64, fan: int = 16) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the byte-level ids of its whole text (null: empty) and an end id; only longer ones than ``capacity`` are cut,
    and only their first piece may be shorter. Sequences are gapless from offset 0. Each row is a document of its own, so rows
    that repeat (null ids too) are packed as often as they occur. An empty table gives no rows; further columns are ignored.
    """
    pieces = materialize(_pieces(docs.select(F.col(doc_id).cast("long"), F.col(text)), vocabulary, capacity))
    one = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    items = pieces.select(F.monotonically_increasing_id().alias("sequence_id"), F.col("length").alias("fill"), F.array(one).alias("pieces"))
    done, level, count = [], 0, pieces.count()
    tasks = -(-count // HELD) or 1
    while True:
        binned = materialize(_binned(items, capacity, level, tasks))
        finished = F.col("fill") * 100 >= capacity * FULL
        left = binned.filter(~finished).count() if tasks > 1 else 0
        fewer = max(-(-tasks // fan), -(-left // HELD), 1)
        if not left or (fewer >= tasks and (count - left) * carry < count):
            break
        done.append(binned.filter(finished))
        items, count, tasks, level = binned.filter(~finished), left, min(fewer, tasks), level + 1
    for table in done:
        binned = binned.unionByName(table)
    return binned.select("sequence_id", F.explode("pieces").alias("at")).select(*[f"at.{name}" for name, _ in PIECE], "sequence_id", "at.offset")

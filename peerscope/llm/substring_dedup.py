"""Passages that stand whole in an earlier document too, found by content-defined chunks and extended byte by byte.

1. A gear rolling hash over ``WINDOW`` bytes is taken at each byte; a cut follows the smallest hash of any ``reach`` bytes in a row, at the start
   of a character; where the same hash is the smallest again and again, as in "at, at, at", only once. Cuts depend on nearby bytes alone, so insertions move them along, and any ``shortest`` bytes that repeat hold the same
   chunk between two cuts. Chunks are 23 bytes on average; there is a row for each.
2. Digests (64 bits, of the chunk and ``CONTEXT`` bytes before it) are counted; a chunk whose digest repeats meets the first and the last earlier
   document that hold it, with the distance of the two places. It goes if the bytes on neither side could make up ``shortest`` bytes
   (two 16-bit fingerprints in its row tell). Chunks that follow each other in both documents are one run.
3. A run is extended over ``shortest`` bytes and more to both sides, by comparing the bytes of both documents there, which are cut out of each
   text once for each place. Runs that then meet are one span; it counts if it is ``shortest`` bytes long.

Shuffled are: a digest for each chunk, twice (once with its place), the texts of documents with runs, and rows for runs. Digests that are
very common are dealt out by salts, from counts of all rows; nothing is collected, dropped or capped. Each span stands whole in one earlier document.
A passage is missed only if other documents hold all of its chunks, some of them before and others after every document that holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.common import join_salted, mixed, numbered, unused
from peerscope.session import materialize

WINDOW, CONTEXT = 8, 5
#: A number for each byte value, from a fixed seed.
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
LONGEST, SHORTEST_RUN = 256, 100
#: A span moves to a blank over so many bytes at most.
NEAR = 32
#: Bytes of text that are chunked together, unless one text is longer.
BATCH_BYTES = 1 << 20
#: Places of texts that are written together.
SEEN = 20_000
#: Random numbers for byte values (256: beyond the text) and for places in a chunk.
NUMBER = np.random.default_rng(11).integers(0, 1 << 64, 257, dtype=np.uint64)
PLACE = np.random.default_rng(13).integers(0, 1 << 64, LONGEST + 4, dtype=np.uint64) | np.uint64(1)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of GEAR[byte k before] << k over the last WINDOW bytes, by doubling the span."""
    total, span = GEAR[data], 1
    while span < WINDOW:
        shifted = np.zeros_like(total)
        shifted[span:] = total[:-span] << np.uint32(span)
        total, span = total + shifted, span * 2
    return total


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` values from each on, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values, span = np.minimum(values[:-step], values[step:]), span + step
    return values


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Where chunks of the texts data[start:end] end and the next ones begin, never inside a character; no chunk is longer than LONGEST.

    A text's first chunk and its last one, which reach its start and its end, are not bounded by two cuts.
    """
    n, text = len(data), np.repeat(np.arange(len(starts)), ends - starts)
    found = np.empty(0, dtype=np.int64)
    place = np.arange(n) - starts[text] + 1
    if n >= reach:
        hashes = gear_hashes(data) | np.uint32(1)
        least = lowest(hashes, reach)
        whole = (place[: len(least)] >= WINDOW) & (text[: len(least)] == text[reach - 1 :])
        edge = np.zeros(reach - 1, dtype=np.uint32)
        greatest = ~lowest(~np.concatenate([edge, np.where(whole, least, np.uint32(0)), edge]), reach)
        found = np.flatnonzero(greatest == hashes)
        again = (hashes[found[1:]] == hashes[found[:-1]]) & (text[found[1:]] == text[found[:-1]])
        found = found[np.append(True, ~again)] + 1 if len(found) else found  # text that goes round is cut where it begins
    inside = np.append((data & 0xC0) == 0x80, False)
    inside[ends] = False
    for _ in range(3):
        found = found - inside[found]
    cut, edge = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    edge[starts] = edge[ends] = True
    cut[found] = True
    edges = np.flatnonzero(cut | edge)
    lengths = np.diff(edges)
    wide = np.flatnonzero(lengths > LONGEST)
    if len(wide):
        step = LONGEST - 3  # a forced cut moves back by up to three bytes, to the start of a character
        pieces = -(-lengths[wide] // step) - 1
        number = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces) + 1
        forced = np.repeat(edges[wide], pieces) + number * step
        for _ in range(3):
            forced = forced - inside[forced]
        cut[forced] = True
    return np.flatnonzero(cut & ~edge)


def reach_of(shortest: int) -> int:
    """The longest reach for which any ``shortest`` bytes hold two cuts with the bytes that decide them."""
    return max(1, (shortest + 1 - WINDOW) // 2)


def chunk_ends(data: np.ndarray, shortest: int = SHORTEST_RUN) -> np.ndarray:
    """Ends of the chunks of one text's UTF-8 bytes."""
    if not len(data):
        return np.empty(0, dtype=np.int64)
    return np.append(cuts(data, np.zeros(1, dtype=np.int64), np.array([len(data)]), reach_of(shortest)), len(data))


class Near:
    """Hashes of the bytes near some places of the texts data[low:high]."""

    def __init__(self, data: np.ndarray):
        self.data = data
        words, span = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64), 1
        while span < 8:  # the eight bytes from each place on
            words[:-span] |= words[span:] << np.uint64(8 * span)
            span *= 2
        self.words = words

    def __call__(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
        """Of ``width`` bytes from each place on; bytes outside of the text's limits are a value of their own."""
        beside = (at < low) | (at + width > high)
        found = np.zeros(len(at), dtype=np.uint64)
        for k in range(0, width, 8):  # the last word overlaps the one before
            word = self.words[np.where(beside, 0, at + min(k, max(width - 8, 0)))]
            found = mixed(found ^ (word if width >= 8 else word << np.uint64(8 * (8 - width))))
        edge = np.flatnonzero(beside)
        where = at[edge, None] + np.arange(width)
        values = np.where((where >= low[edge, None]) & (where < high[edge, None]), self.data[np.clip(where, 0, len(self.data) - 1)], 256)
        found[edge] = mixed((NUMBER[values] * PLACE[:width]).sum(axis=1, dtype=np.uint64))
        return found


def _sides(shortest: int) -> int:
    """Bytes beside a chunk that agree on one side at least, if it is part of ``shortest`` bytes that repeat."""
    return max(1, (shortest - reach_of(shortest) - CONTEXT) // 2 + 1)


def chunk_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, ...]:
    """(text, start, size, fingerprints of both sides, digest) of the chunks between two cuts of their text; the start is the context's."""
    at = cuts(data, starts, ends, reach_of(shortest))
    text = np.searchsorted(ends, at, "right")
    both = np.flatnonzero(text[1:] == text[:-1])
    text, begin, end = text[both], at[both], at[both + 1]
    if not len(both):
        return text, begin, begin, begin, begin.astype(np.uint64)
    bounds = np.column_stack([begin, end]).reshape(-1)
    low, high = at[0], at[-1]
    inner = np.arange(low, high) - np.repeat(at[:-1], np.diff(at))
    terms = NUMBER[data[low:high]] * PLACE[np.minimum(inner, LONGEST + 3)]
    sums = np.add.reduceat(np.append(terms, np.uint64(0)), bounds - low)[::2]
    low, high = starts[text], ends[text]
    size, side, near = end - begin, _sides(shortest), Near(data)
    digest = mixed(sums + size.astype(np.uint64)) ^ near(begin - CONTEXT, low, high, CONTEXT)
    around = ((near(begin - CONTEXT - side, low, high, side) & np.uint64(0xFFFF)) << np.uint64(16)) | (near(end, low, high, side) & np.uint64(0xFFFF))
    first = begin - CONTEXT
    for _ in range(3):
        first = first + ((data[first] & 0xC0) == 0x80)
    return text, first - low, end - first, around.astype(np.int64), mixed(digest)


def _chunks(docs: DataFrame, shortest: int) -> DataFrame:
    """(digest, doc_id, place, size): place holds the start and both fingerprints."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        body = batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(body.buffers()[1], dtype=np.int64, count=len(body) + 1, offset=8 * body.offset)
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.empty(0, dtype=np.uint8)
        some = np.flatnonzero(offsets[1:] > offsets[:-1])
        text, start, size, around, digest = chunk_rows(data, offsets[some] - low, offsets[some + 1] - low, shortest)
        ids = batch.column(0).to_numpy(zero_copy_only=False)[some]
        columns = [pa.array(digest.view(np.int64)), pa.array(ids[text], pa.int64()), pa.array((start << 32) | around), pa.array(size.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "place", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
            for at in range(0, batch.num_rows, step):
                yield rows(batch.slice(at, step))

    return docs.mapInArrow(run, "digest long, doc_id long, place long, size int")


def _pairs(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, first_doc_id, shift, start, size) of chunks that an earlier document holds and that may be part of a span."""
    chunks = _chunks(docs, shortest)
    counts = materialize(chunks.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"))
    repeated = materialize(join_salted(chunks, counts, "digest", "n", "doc_id"))
    holder = F.struct("doc_id", "place")
    earlier = Window.partitionBy("digest", "salt").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    held = repeated.select("*", F.min(holder).over(earlier).alias("first"), F.max(holder).over(earlier).alias("last"))
    # the digests with several salts are a fixed number at most
    dealt = repeated.filter("salts > 1").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", F.struct("doc_id", "place")).alias("place"))
    dealt = F.broadcast(materialize(dealt.select("digest", holder.alias("least"))))
    held = held.join(dealt, "digest", "left").withColumn("first", F.when(F.col("least.doc_id") < F.col("doc_id"), F.col("least")).otherwise(F.col("first")))
    pairs = held.filter("first is not null").select("doc_id", "place", "size", F.explode(F.array_distinct(F.array_compact(F.array("first", "last")))).alias("at"))
    apart = F.col("place").bitwiseXOR(F.col("at.place"))
    may_be = (apart.bitwiseAND(0xFFFF) == 0) | (apart.bitwiseAND(0xFFFF0000) == 0) | (F.col("size") >= shortest - 2 * (_sides(shortest) - 1))
    start = F.shiftright("place", 32)
    return pairs.filter(may_be).select("doc_id", F.col("at.doc_id").alias("first_doc_id"), (start - F.shiftright("at.place", 32)).alias("shift"), start.alias("start"), "size")


def _runs(rows: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, shift, start, end): rows with the same documents and shift that touch or overlap are one."""
    in_place = Window.partitionBy("doc_id", "first_doc_id", "shift").orderBy("start", "end")
    new = F.coalesce(F.max("end").over(in_place.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True)).cast("int")
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(in_place.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "first_doc_id", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _sights(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(place, bytes) for distinct places (doc_id, at, after): the bytes before, or from that byte on, as many as ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, body, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = body.as_py().encode()
                for at, after in ((x["at"], x["after"]) for x in wanted):
                    found.append((key, at, after, data[at : at + width] if after else data[max(0, at - width) : at]))
                if len(found) >= SEEN:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)

    def rows(found: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
        key, at, after, seen = zip(*found, strict=True)
        place = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(after)], ["doc_id", "at", "after"])
        return pa.RecordBatch.from_arrays([place, pa.array(seen, pa.binary())], ["place", "bytes"])

    listed = places.groupBy("doc_id").agg(F.collect_set(F.struct("at", "after")).alias("wanted"))
    return docs.join(listed, "doc_id").mapInArrow(run, "place struct<doc_id:long,at:long,after:boolean>, bytes binary")


def same_before(a: bytes, b: bytes) -> int:
    """How many bytes at the ends of both agree, as whole characters."""
    n = min(len(a), len(b))
    if not n:
        return 0
    apart = np.flatnonzero(np.frombuffer(a, np.uint8)[len(a) - n :] != np.frombuffer(b, np.uint8)[len(b) - n :])
    same = n - 1 - int(apart[-1]) if len(apart) else n
    while same and a[len(a) - same] & 0xC0 == 0x80:
        same -= 1
    return same


def same_after(a: bytes, b: bytes, width: int) -> int:
    """How many bytes at the starts of both agree, as whole characters; both hold three bytes more than the ``width`` that counts, or end."""
    n = min(len(a), len(b), width)
    if not n:
        return 0
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    same = int(apart[0]) if len(apart) else n
    while same and same < len(a) and a[same] & 0xC0 == 0x80:
        same -= 1
    return same


def _extended(runs: DataFrame, docs: DataFrame, shortest: int) -> DataFrame:
    """The runs with as many bytes more on both sides as agree, up to ``shortest`` ones."""
    width = shortest + 3
    ends = runs.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("after"), F.col("start").alias("own"), (F.col("start") - F.col("shift")).alias("other")),
                F.struct(F.lit(True).alias("after"), F.col("end").alias("own"), (F.col("end") - F.col("shift")).alias("other")),
            )
        ).alias("side"),
    ).select("doc_id", "first_doc_id", "shift", "start", "end", "side.*")
    place = [F.struct(F.col(d).alias("doc_id"), F.col(at).alias("at"), "after").alias("place") for d, at in (("doc_id", "own"), ("first_doc_id", "other"))]
    uses = materialize(ends.select(place[0]).unionAll(ends.select(place[1])).groupBy("place").agg(F.count("*").alias("n")))
    sights = materialize(_sights(docs, uses.select("place.*"), width).join(uses, "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after, a, b = (batch.column(k).to_pylist() for k in (5, 6, 7))
            more = [same_after(x, y, shortest) if to else same_before(x, y) for to, x, y in zip(after, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(after), pa.array(more, pa.int64())], ["doc_id", "first_doc_id", "shift", "start", "end", "after", "more"])

    kept = ["doc_id", "first_doc_id", "shift", "start", "end", "after"]
    own = join_salted(ends.withColumn("place", place[0]), sights, "place", "n", "start").select(*kept, "other", F.col("bytes").alias("a"))
    met = join_salted(own.withColumn("place", place[1]), sights, "place", "n", "doc_id").select(*kept, "a", F.col("bytes").alias("b"))
    found = met.mapInArrow(run, "doc_id long, first_doc_id long, shift long, start long, end long, after boolean, more long")
    sides = [F.sum(F.when(F.col("after") == to, F.col("more"))).alias(name) for to, name in ((False, "before"), (True, "behind"))]
    whole = found.groupBy("doc_id", "first_doc_id", "shift", "start", "end").agg(*sides)
    return whole.select("doc_id", "first_doc_id", "shift", (F.col("start") - F.col("before")).alias("start"), (F.col("end") + F.col("behind")).alias("end"))


def _texts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents with an id and a text, the texts of the ids that repeat): of the texts of one id the smallest counts."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("doc_id is not null")
    ids = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    chosen = materialize(rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    return rows.join(ids, "doc_id", "left_anti").unionAll(chosen), chosen


def _spans(texts: DataFrame, shortest: int) -> DataFrame:
    pairs = _pairs(texts, shortest).select("doc_id", "first_doc_id", "shift", "start", (F.col("start") + F.col("size")).alias("end"))
    runs = materialize(_runs(pairs))
    spans = _runs(_extended(runs, texts, shortest)).filter(F.col("end") - F.col("start") >= shortest)
    # one that lies in another one says nothing new; of equal ones the smallest first document stays
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "first_doc_id", "shift").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("reached", F.max("end").over(before)).filter(F.col("reached").isNull() | (F.col("reached") < F.col("end")))
    return new.select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "first_doc_id")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest_run: int = SHORTEST_RUN) -> DataFrame:
    """Spans that repeat an earlier document, one row each: doc_id, start, length (bytes of the text's UTF-8), first_doc_id.

    Each span stands whole in the document first_doc_id. Spans of different first documents may overlap, but none lies in another one.
    Rows without an id keep their texts, as do null and empty texts; rows that repeat an id are one document with the smallest of their
    texts. An empty table gives no rows; further columns are ignored.
    """
    return _spans(_texts(docs, doc_id, text)[0], shortest_run)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans (start, length in bytes), each shrunk to whole words, or to whole characters if no blank is near its end."""
    data, out, at = text.encode(), [], 0
    for start, length in sorted(spans):
        end = min(start + length, len(data))
        blanks = [i for i in (*range(start, min(start + NEAR, end)), *range(max(start, end - NEAR), end)) if data[i] in b" \t\n\v\f\r"]
        if 0 < start < end and data[start - 1] not in b" \t\n\v\f\r":
            start = blanks[0] + 1 if blanks and blanks[0] < start + NEAR else start
            while start < end and data[start] & 0xC0 == 0x80:
                start += 1
        if start < end < len(data) and data[end] not in b" \t\n\v\f\r":
            end = blanks[-1] + 1 if blanks and blanks[-1] >= end - NEAR else end
            while start < end and data[end] & 0xC0 == 0x80:
                end -= 1
        if max(start, at) < end:
            out.append(data[at : max(start, at)])
            at = end
    return b"".join([*out, data[at:]]).decode()


def cut_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, and without the spans that repeat earlier documents.

    Null ids and null texts stay as they are; of rows that repeat an id those with the smallest text are cut. Columns may have any names.
    """
    texts, chosen = _texts(docs, doc_id, text)
    key, spans, least = unused(docs, "key", "spans", "least")
    listed = _spans(texts, SHORTEST_RUN).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "length")).alias(spans))
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names) + 2)]
            bodies = [
                body if not found or body is None or (only is not None and only != body) else without(body, [(x["start"], x["length"]) for x in found])
                for body, found, only in zip(*(columns[k].to_pylist() for k in (at, len(names), len(names) + 1)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*columns[:at], pa.array(bodies, pa.string()), *columns[at + 1 : len(names)]], names)

    own = F.col(f"`{doc_id}`").cast("long")
    joined = docs.join(listed, own == F.col(key), "left").drop(key).join(chosen.select(F.col("doc_id").alias(key), F.col("text").alias(least)), own == F.col(key), "left")
    return numbered(joined.select(*[F.col(f"`{c}`") for c in names], spans, least)).mapInArrow(run, docs.schema)

"""Fill-in-middle: texts cut at unit ends into prefix, middle and suffix, and put together in another order.

Units are lines or characters. A batch's UTF-8 bytes are seen as 64-bit words; arithmetic on a word sets the high bit of each byte
that ends a unit (lines: bytes equal to the line break; characters: bytes that no continuation byte follows), a population count gives
the marks of each word, and their running sums answer all rows of the batch together: the marks before a byte, and the byte after the
k-th mark, by binary search for its word and at most seven steps inside it. Nothing is decoded, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every byte's high bit, its other bits, and a line break in every byte.
HIGH, LOW, BREAKS = (np.uint64(int(f"{b:02x}" * 8, 16)) for b in (0x80, 0x7F, 0x0A))
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text that are worked on together, unless one text is longer.
BATCH_BYTES = 4 << 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def line_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each line break; exact, as no carry leaves a byte."""
    x = words ^ BREAKS
    return ~(((x & LOW) + LOW) | x | LOW)


def character_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that the next byte does not continue."""
    goes_on = words & ~(words << np.uint64(1)) & HIGH
    following = np.append(goes_on[1:], np.uint64(0))
    return HIGH & ~((goes_on >> np.uint64(8)) | (following << np.uint64(56)))


class Marks:
    """Rank and select over the marked bytes of some words."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.upto[1:])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before the given ones."""
        word, inside = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return self.upto[word] + np.bitwise_count(self.marks[word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th mark, k from 1; without so many marks any number."""
        word = np.minimum(np.searchsorted(self.upto, k, "left") - 1, len(self.marks) - 1)
        left, marks = k - self.upto[word], self.marks[word].copy()
        for step in range(1, 8):
            marks = np.where(left > step, marks & (marks - np.uint64(1)), marks)
        lowest = marks & (~marks + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)) >> 3) + 1


def cuts(data: bytes, starts: np.ndarray, ends: np.ndarray, unit: str, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, end of the prefix, end of the middle, characters of the prefix, of the middle) of each text ``data[start:end]``.

    The two draws of a text, modulo its units and one, are the units of the prefix, and of prefix and middle; the smaller is the first.
    """
    padded = np.zeros((len(data) >> 3) + 2, dtype="<u8")
    octets = padded.view(np.uint8)
    octets[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    characters = Marks(character_marks(padded))
    marks = characters if unit == "character" else Marks(line_marks(padded))
    first = marks.before(starts)
    whole = marks.before(ends) - first
    n = whole + ((ends > starts) & (octets[ends - 1] != 0x0A)) if unit == "line" else whole  # a last line may lack its break
    places = np.sort(draws % (n + 1)[:, None].astype(np.int64), axis=1)
    found = []
    for k in places.T:
        at = marks.after(np.maximum(first + np.minimum(k, whole), 1))
        found.append(np.where(k == 0, starts, np.where(k > whole, ends, at)))
    chars = [characters.before(x) for x in (starts, *found)]
    return n, *found, chars[1] - chars[0], chars[2] - chars[1]


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (characters; null if plain), output.

    The four draws are the first 32-bit groups of the hash of seed and id: two for the ends of prefix and middle, one against
    ``rate`` (per cent of texts that are cut), one against ``spm_rate``. ``psm`` is <P>prefix<S>suffix<M>middle, ``spm``
    <S>suffix<P>prefix<M>middle; ``plain`` texts stay as they are: empty ones, those not drawn, and those that hold a marker, so
    that ``restored`` always gives the text back. A null text is empty; a null id draws as the seed alone, so rows that repeat an id
    are cut by the same draws; each row is a document of its own. An empty table gives no rows, further columns are ignored.
    """
    if unit not in ("line", "character"):
        raise ValueError("unit is line or character")
    if any(x[0] in y[1:] for x in markers for y in markers):
        raise ValueError("the first character of a marker may not stand inside of one")
    p, s, m = (x.encode() for x in markers)

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        body = batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(body.buffers()[1], dtype=np.int64, count=len(body) + 1, offset=8 * body.offset)
        low, high = int(offsets[0]), int(offsets[-1])
        data = body.buffers()[2].to_pybytes()[low:high] if high > low else b""
        starts, ends = offsets[:-1] - low, offsets[1:] - low
        draws = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)])
        n, first, second, before, middle = cuts(data, starts, ends, unit, draws[:, :2])
        forms, out, cut = [], [], np.ones(len(starts), dtype=bool)
        for i, (a, b, c, d) in enumerate(zip(starts.tolist(), first.tolist(), second.tolist(), ends.tolist(), strict=True)):
            whole = data[a:d]
            if a == d or draws[i, 2] % 100 >= rate or p in whole or s in whole or m in whole:
                forms.append("plain")
                out.append(whole)
                cut[i] = False
            elif draws[i, 3] % 100 < spm_rate:
                forms.append("spm")
                out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
            else:
                forms.append("psm")
                out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
        shown = [pa.array(x, pa.int64(), mask=~cut) for x in (before, middle)]
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *shown, pa.array(out, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
            for at in range(0, batch.num_rows, rows):
                yield pieces(batch.slice(at, rows))

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"draw{k}") for k in range(4)]
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body, *groups).mapInArrow(run, OUT)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of: no marker stands in its parts, and none arises where a part meets a marker, as first characters stand nowhere inside of one."""
    parts = F.split(output, "|".join(re.escape(x) for x in markers), 4)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
